"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of ten words (a shorter item is one window); a
document is hit where it holds all words of a window in a row. The windows'
shingles (three words) are ordered by rarity over all documents. For full
containment the necessary prefix is one shingle, the rarest of the window, so
only that shingle is joined with the documents' shingles. A match must leave
room for the window before and after (positional and length bound) and is then
verified word by word.

The first pass over the documents counts the items' shingles, the second looks
for the prefix shingles. Both test a bit table of fixed size, so what is
broadcast doesn't grow with the items; a full table only lets more candidates
through to the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertspark.llm.common import Scratch, WordHasher, Words, alnum_words, bit_table, in_table, mix, tidied

#: Counts that a task gathers before it hands them on.
FLUSH = 100_000

_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s += h[j : len(h) - k + 1 + j] * _PLACE[j]
    return mix(s)


def item_windows(items: DataFrame, size: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """One row per window of an item: item, words, and the hashes of its shingles of min(shingle, words) words."""
    schema = "item string, words array<string>, k int, shingles array<long>"

    def run(batches):
        hasher = WordHasher(alnum_words())
        for batch in batches:
            out = []
            for some in hasher.batches(batch.column(1), keep_text=True):
                for i, (a, b) in enumerate(zip(some.at[:-1], some.at[1:])):
                    words = [some.text(j).decode() for j in range(a, b)]
                    item = batch.column(0)[some.first + i].as_py()
                    for s in range(max(len(words) - size, 0) + 1) if words else ():
                        n = min(len(words), size)
                        k = min(shingle, n)
                        out.append((item, words[s : s + n], k, shingle_hashes(some.hashes[a + s : a + s + n], k).view(np.int64).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "words", "k", "shingles"), r)) for r in out], pa.schema([("item", pa.string()), ("words", pa.list_(pa.string())), ("k", pa.int32()), ("shingles", pa.list_(pa.int64()))]))

    return items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), text_col).mapInArrow(tidied(run), schema)


def _hits(some: Words, table: np.ndarray, sizes: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of the shingles that pass the table; a shingle may not cross a document's end."""
    out = []
    for k in sizes:
        s = shingle_hashes(some.hashes, k)
        at = np.flatnonzero(in_table(table, s))
        doc = np.searchsorted(some.at, at, "right") - 1
        at = at[at + k <= some.at[doc + 1]]
        out.append((k, at, s[at]))
    return out


def shingle_counts(docs: DataFrame, table, sizes: list[int], text_col: str) -> DataFrame:
    """(hash, n): how often each shingle that passes the table occurs in all documents."""

    def run(batches):
        hasher = WordHasher(alnum_words())
        held: dict[int, int] = {}

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["hash", "n"])
            held.clear()
            return made

        for batch in batches:
            for some in hasher.batches(batch.column(0)):
                for _, _, s in _hits(some, table.value, sizes):
                    for h, n in zip(*(x.tolist() for x in np.unique(s.view(np.int64), return_counts=True))):
                        held[h] = held.get(h, 0) + n
                if len(held) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select(text_col).mapInArrow(tidied(run), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def scan(docs: DataFrame, table, sizes: list[int], size: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, n_words, and each prefix shingle found: hash, place, and the words around it."""
    hit = T.StructType.fromDDL("hash long, pos int, from int, around string")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit))])
    arrow = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("from", pa.int32()), ("around", pa.string())]))

    def run(batches):
        hasher = WordHasher(alnum_words())
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            hits: list = [None] * batch.num_rows
            for some in hasher.batches(batch.column(1), keep_text=True):
                n[some.first : some.first + len(some.at) - 1] = np.diff(some.at)
                for _, at, s in _hits(some, table.value, sizes):
                    for place, h in zip(at.tolist(), s.view(np.int64).tolist()):
                        d = int(np.searchsorted(some.at, place, "right")) - 1
                        a, b = int(some.at[d]), int(some.at[d + 1])
                        lo, hi = max(a, place - size + 1), min(b, place + size)
                        around = b" ".join(some.text(j) for j in range(lo, hi)).decode()
                        row = hits[some.first + d] or []
                        row.append({"hash": h, "pos": place - a, "from": lo - a, "around": around})
                        hits[some.first + d] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(hits, arrow)], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(tidied(run), schema)


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Where documents hold windows of benchmark items.

    Words are runs of ASCII digits, letters (A-Z in lower case) and non-ASCII
    characters. A window is ``size`` consecutive words of an item, or the whole
    item when it has fewer, but not none.

    One row per input row: id, n_words, n_hit (words inside any occurrence of a
    window), n_items (items with occurring windows), items (their ids as sorted
    strings), items_sha256 (of these, comma-joined), contaminated (n_hit > 0).
    A null text has no words; items with a null id or no words have no windows;
    items that share an id count as one. Repeated documents give repeated rows,
    a null id stays null, other columns are not read.
    """
    if not 1 <= shingle <= min(3, size):
        raise ValueError("shingle must be 1 to 3 words and no longer than a window")
    scratch, sc = Scratch(docs.sparkSession), docs.sparkSession.sparkContext
    windows = item_windows(items, size, shingle, item_id, item_text).withColumn("win", F.monotonically_increasing_id())
    windows = scratch.keep(windows, "windows")
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most ``shingle`` values
    each = scratch.keep(windows.select("win", F.posexplode("shingles").alias("offset", "hash")), "shingles")
    counts = scratch.keep(shingle_counts(docs, sc.broadcast(bit_table(each, "hash")), sizes, text_col), "counts")
    # a shingle that no document has leaves its window without occurrences; else the rarest is the prefix
    ranked = scratch.keep(each.join(counts, "hash", "left").select("win", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "offset").alias("s")), "ranked")
    prefix = ranked.groupBy("win").agg(F.min("s").alias("s")).filter("s.n > 0").select("win", "s.hash", "s.offset")
    prefix = scratch.keep(scratch.keep(prefix, "prefix").join(windows.select("win", "item", "words"), "win").drop("win"), "windows_by_prefix")
    found = scan(docs, sc.broadcast(bit_table(prefix, "hash")), sizes, size, id_col, text_col)
    found = scratch.keep(found.withColumn("row", F.monotonically_increasing_id()), "scan")

    hits = found.filter(F.size("hits") > 0).select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", "h.*")
    start, length = F.col("pos") - F.col("offset"), F.size("words")
    fits = (start >= 0) & (start + length <= F.col("n_words"))
    same = F.slice(F.split("around", " "), start - F.col("from") + 1, length) == F.col("words")
    places = hits.join(prefix, "hash").filter(fits).filter(same).select("row", start.alias("start"), length.alias("length"), "item")
    places = scratch.keep(places, "places")
    covered = places.select("row", "start", "length").distinct().select("row", F.explode(F.expr("sequence(start, start + length - 1)")).alias("p")).distinct()
    n_hit = scratch.keep(covered.groupBy("row").agg(F.count("*").alias("n_hit")), "covered")
    by_row = scratch.keep(places.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")), "items")
    rows = found.drop("hits").join(n_hit, "row", "left").join(by_row, "row", "left")
    scratch.drop_all_but("scan", "covered", "items")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        listed.alias("items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
