"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: elements with the same path (tags and
classes from the root) are one node of the host's tree. A node is judged over
the m pages that have it (equal pages of a host are one page, however often
they are repeated):

  presentation  entropy, to base m, of the sequences of child tags it shows
  content       of a text seen at that node on k pages: 1 - log k / log m, one
                for a text of a single page, zero for a text on every page
  composite     (1 - GAMMA) * presentation of the parent + GAMMA * content

A text whose composite importance is below ``threshold`` is cut from every page
of the host, and with it every branch that has no other text. Hosts with too
few pages say nothing and lose nothing. Branches that HTML itself marks as none
of the article (nav, footer, aside, form, adverts, comments, ...) have no
importance on any page, and where a page has an article element, only that has.

The tree is counted by Spark as (node, what was seen) rows; no host is ever
gathered in one task. What reaches the pages again is the set of unimportant
texts: broadcast up to LOW_BROADCAST of them, else joined by page.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertspark.llm.common import Scratch, bit_table, in_table, slices
from alertspark.llm.html_blocks import Page, hash64, read_page

GAMMA = 0.9
MIN_PAGES = 8
LOW_BROADCAST = 200_000
_PRESENT, _STYLE, _TEXT = 0, 1, 2


def host_of(url: str | None) -> str:
    """Host name of a URL in lower case; empty where there is none."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]
    return rest.rsplit("@", 1)[-1].split(":", 1)[0].lower()


def _node(host: str, path: int) -> int:
    return hash64(host, str(path))


def _text_key(node: int, text: str) -> int:
    return hash64(str(node), text)


def style_tree(pages: DataFrame) -> DataFrame:
    """(node, kind, seen, parent, pages): how many distinct pages show each presence, style and text of each node. Input: url, html.

    Only pages whose html may be repeated (a bit table of fixed size tells)
    carry their digest into the count; all others are one page each.
    """
    schema = "node long, kind int, seen long, parent long, page long"
    pages = pages.select("url", "html", F.xxhash64("html").alias("page"))
    spark = pages.sparkSession
    repeated = spark.sparkContext.broadcast(bit_table(pages.groupBy("page").agg(F.count("*").alias("n")).filter("n > 1"), "page"))

    def run(batches):
        for batch in (s for b in batches for s in slices(b)):
            rows: list[tuple[int, int, int, int, int | None]] = []
            digests = batch.column(2).to_numpy()
            again = in_table(repeated.value, digests.view(np.uint64)).tolist()
            for url, html, digest, twice in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), digests.tolist(), again):
                page, host, own = read_page(html or ""), host_of(url), digest if twice else None
                names: dict[int, int] = {}
                name = lambda p: names.get(p) or names.setdefault(p, _node(host, p))  # noqa: B023, E731
                mine = set()
                for b in page.article():
                    node, parent = name(b.path), name(b.parent)
                    mine |= {(node, _PRESENT, 0, 0, own), (parent, _PRESENT, 0, 0, own), (node, _TEXT, _text_key(node, b.text), parent, own), (parent, _STYLE, hash64(page.styles.get(b.parent, "")), 0, own)}
                rows += mine
            cols = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["node", "kind", "seen", "parent", "page"])

    seen = pages.mapInArrow(run, schema).groupBy("node", "kind", "seen", "parent", "page").agg(F.count("*").alias("n"))
    return seen.groupBy("node", "kind", "seen", "parent").agg(F.sum(F.when(F.col("page").isNull(), F.col("n")).otherwise(1)).alias("pages"))


def unimportant(tree: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Keys of the texts whose composite importance is below the threshold."""
    known = scratch.keep(tree.filter((F.col("kind") == _PRESENT) & (F.col("pages") >= MIN_PAGES)).select("node", F.col("pages").alias("m")), "present")
    often = tree.filter((F.col("kind") == _TEXT) & (F.col("pages") >= MIN_PAGES)).select("node", "parent", F.col("seen").alias("key"), F.col("pages").alias("k"))
    content = often.join(known, "node").select("key", "parent", (1 - F.log("k") / F.log("m")).alias("content"))
    content = scratch.keep(content.filter(F.col("content") * GAMMA < threshold), "content")
    styles = tree.filter(F.col("kind") == _STYLE).select("node", "pages").join(known, "node")
    share = F.col("pages") / F.col("m")
    style = scratch.keep(styles.withColumn("h", -share * F.log(share) / F.log("m")).groupBy("node").agg(F.sum("h").alias("style")), "style")
    judged = content.join(style.select(F.col("node").alias("parent"), "style"), "parent", "left")
    return judged.filter((1 - GAMMA) * F.coalesce("style", F.lit(1.0)) + GAMMA * F.col("content") < threshold).select("key")


def kept_text(page: Page, host: str, is_low) -> tuple[str, int]:
    """(the texts that are important, joined by newlines; how many were cut)."""
    said, cut, names = [], 0, {}
    for b in page.article():
        node = names.get(b.path)
        if node is None:
            node = names[b.path] = _node(host, b.path)
        if is_low(_text_key(node, b.text)):
            cut += 1
        else:
            said.append(b.text)
    return "\n".join(said), cut


def main_text(pages: DataFrame, threshold: float = 0.1, low_broadcast: int = LOW_BROADCAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The article's text of every page.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by a newline. One row per input row:
    id, url, text, n_chars (code points), n_cut (texts cut by the style tree).
    Null or empty html: empty text; null url: the pages of no host, judged
    together. Repeated rows give repeated results, but equal pages of a host
    count once in its style tree; a null id stays null; other columns are not
    read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tree = scratch.keep(style_tree(src.select("url", "html")), "tree")
    low = scratch.keep(unimportant(tree, threshold, scratch), "low")
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], *T.StructType.fromDDL("text string, n_chars long, n_cut long").fields])
    few = low.count() <= low_broadcast
    if few:
        shared = spark.sparkContext.broadcast(np.sort(low.toArrow().column("key").to_numpy()))
    else:
        src = _with_own_low(src, low, scratch)
        shared = None

    def run(batches):
        if shared is not None:
            everywhere = frozenset(shared.value.tolist())
        for batch in (s for b in batches for s in slices(b)):
            rows = []
            own = batch.column(3).to_pylist() if shared is None else [None] * batch.num_rows
            for url, html, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), own):
                lows = everywhere if shared is not None else frozenset(mine or ())
                rows.append(kept_text(read_page(html or ""), host_of(url), lows.__contains__))
            texts = [r[0] for r in rows]
            cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def _with_own_low(src: DataFrame, low: DataFrame, scratch: Scratch) -> DataFrame:
    """``src`` with the unimportant keys of each page's own texts; equal pages share them."""
    keyed = src.withColumns({"p1": F.xxhash64("url", "html"), "p2": F.xxhash64(F.lit(1), "url", "html")})

    def run(batches):
        for batch in (s for b in batches for s in slices(b)):
            rows = set()
            for url, html, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                host = host_of(url)
                for x in read_page(html or "").article():
                    rows.add((a, b, _text_key(_node(host, x.path), x.text)))
            cols = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["p1", "p2", "key"])

    texts = keyed.select("url", "html", "p1", "p2").mapInArrow(run, "p1 long, p2 long, key long")
    own = scratch.keep(texts.join(low, "key"), "own")
    own = scratch.keep(own.groupBy("p1", "p2").agg(F.collect_set("key").alias("low")), "own_by_page")
    return keyed.join(own, ["p1", "p2"], "left").select("id", "url", "html", "low")
