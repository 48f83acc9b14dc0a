"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of word shingles, 256 minima, 51 band keys of five
   minima each, and a packed sketch of the low two bits of every minimum.
2. Texts with equal sets form one class; classes, not copies, are compared.
3. Classes that share a band key are candidates. Inside a bucket they are not
   paired with each other: the member that meets most others is compared with
   all members, and buckets whose members are one component then are settled.
4. Classes of the buckets that remain (many are near some centre without
   reaching the threshold) are joined exactly: shingles ordered by rarity, only
   the necessary prefixes meet, within the length and positional bounds, and
   only across components. This is the exact way for what pivots leave open.
5. A candidate pair's similarity is estimated by counting equal sketch lanes,
   corrected for chance collisions; pairs far below the threshold go. The rest
   are confirmed on their full sets.

A pair at the threshold 0.8 shares no band with probability (1 - 0.8^5)^51 =
1.6e-9, and is more than six standard errors above the sketch's cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertspark.llm.common import Scratch, WordHasher, bit_table, in_table, mix, spaced_words, tidied

MINIMA, ROWS, BITS = 256, 5, 2
BANDS = MINIMA // ROWS
LANES = 64 // BITS
#: A pair goes on to the full sets when its estimate is at most so far below the threshold (6 standard errors).
MARGIN = 0.18

SIGNATURE = "n_shingles long, set_hi long, set_lo long, bands array<long>, sketch array<long>"


class Signer:
    """Shingle sets and their signatures, from the hashed words of many texts at once."""

    def __init__(self, words: int, seed: int = 11):
        self.words = words
        rng = np.random.default_rng(seed)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = odd(words)
        self.short = odd(1)[0]
        self.a = (odd(MINIMA) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
        self.b = (odd(MINIMA) >> np.uint64(31)).astype(np.uint32)
        self.band_place = odd(ROWS)
        self.band_salt = odd(BANDS)
        self.room = np.empty((1024, MINIMA), np.uint32)
        self.hasher = WordHasher(spaced_words())

    def rolled(self, h: np.ndarray) -> np.ndarray:
        k = self.words
        if len(h) < k:
            return np.zeros(0, np.uint64)
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s += h[j : len(h) - k + 1 + j] * self.place[j]
        return mix(s)

    def minima(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), len(self.room)):
            part = x[i : i + len(self.room), None]
            room = self.room[: len(part)]
            np.multiply(part, self.a, out=room)
            np.add(room, self.b, out=room)
            np.minimum(least, np.minimum.reduce(room, axis=0), out=least)
        return least

    def bands(self, least: np.ndarray) -> np.ndarray:
        rows = least[: BANDS * ROWS].reshape(-1, ROWS).astype(np.uint64)
        return mix((rows * self.band_place).sum(axis=1, dtype=np.uint64) + self.band_salt)

    @staticmethod
    def sketch(least: np.ndarray) -> np.ndarray:
        m = least ^ (least >> np.uint32(16))
        m = m * np.uint32(0x85EBCA6B)
        m = m ^ (m >> np.uint32(13))
        low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, LANES)
        return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)

    def shingles(self, texts: pa.Array):
        """The sorted distinct shingle hashes of each text, some texts at a time."""
        for some in self.hasher.batches(texts):
            rolled = self.rolled(some.hashes)
            sets = []
            for a, b in zip(some.at[:-1].tolist(), some.at[1:].tolist()):
                if a == b:
                    sets.append(np.zeros(0, np.uint64))
                elif b - a < self.words:
                    sets.append(mix((some.hashes[a:b] * self.place[: b - a]).sum(keepdims=True, dtype=np.uint64) + self.short * np.uint64(b - a)))
                else:
                    sets.append(np.unique(rolled[a : b - self.words + 1]))
            yield sets

    def sign(self, texts: pa.Array) -> list[tuple]:
        """(set size, two halves of the set's digest, band keys, sketch) of every text; nulls for an empty set."""
        out = []
        for s in (s for some in self.shingles(texts) for s in some):
            if not len(s):
                out.append((0, None, None, None, None))
                continue
            least = self.minima(s)
            hi, lo = mix(s ^ self.short).sum(dtype=np.uint64), mix(s + self.short).sum(dtype=np.uint64)
            out.append((len(s), hi.astype(np.int64), lo.astype(np.int64), self.bands(least).view(np.int64), self.sketch(least).view(np.int64)))
        return out


def shingle_set(text: str | None, words: int) -> set[tuple[bytes, ...]]:
    """The full set of a text: its runs of ``words`` words, or all its words when it has fewer."""
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*(w[j:] for j in range(words))))


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, two hashes of its text (to find the text again), and its signature."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"))
    fields = [texts.schema["id"], *T.StructType.fromDDL("t1 long, t2 long").fields, *T.StructType.fromDDL(SIGNATURE).fields]
    schema = T.StructType(fields)

    def run(batches):
        signer = Signer(words)
        longs = pa.list_(pa.int64())
        for batch in batches:
            n, hi, lo, bands, sketch = zip(*signer.sign(batch.column(1))) if batch.num_rows else ((),) * 5
            cols = [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, longs), pa.array(sketch, longs)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return texts.mapInArrow(tidied(run), schema)


def estimated_similarity(a: str, b: str) -> F.Column:
    """Similarity by equal sketch lanes, corrected for the chance 2^-BITS that unequal minima agree."""
    lanes = (1 << 64) // 3  # 0101...: the low bit of each lane
    unequal = F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1)) & {lanes}L)), 0, (s, n) -> s + n)"
    )
    equal = 1 - unequal / F.lit(MINIMA)
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, and the text hashes of both) whose full sets have 100 * both >= percent * either."""
    left = texts.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("t").alias("ta"))
    right = texts.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("t").alias("tb"))
    full = pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a", "b", "ta", "tb")

    def run(batches):
        last: tuple = (None, set())
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                ta, tb = ta.as_py(), tb.as_py()
                if ta != last[0]:
                    last = ta, shingle_set(ta, words)
                x, y = last[1], shingle_set(tb, words)
                both = len(x & y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(tidied(run), pairs.select("a", "b").schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): (node, label), the label the smallest node reachable.

    Each step takes the smallest label among the neighbours and then the label
    of the label, so long chains halve; every step is a written table.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = scratch.keep(labels.join(scratch.keep(near, "near"), "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("was")), "step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = scratch.keep(step.join(jump, "label").select("node", F.col("further").alias("label"), "was"), "labels")
        if labels.filter("label < was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


class _Links:
    """Candidate pairs to links to components, over the classes that share a band with another."""

    def __init__(self, of_class: DataFrame, texts: DataFrame, nodes: DataFrame, scratch: Scratch, words: int, percent: int):
        self.of_class, self.texts, self.scratch, self.words, self.percent = of_class, texts, scratch, words, percent
        self.labels = nodes.select("node", F.col("node").alias("label"))
        self.found = False

    def test(self, pairs: DataFrame) -> None:
        """Confirm the pairs (a, b) and join the components of those that are links."""
        side = lambda s: self.of_class.select(F.col("node").alias(s), F.col("t1").alias(f"{s}1"), F.col("t2").alias(f"{s}2"), F.col("sketch").alias(f"s{s}"))
        least = self.percent / 100 - MARGIN
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter(estimated_similarity("sa", "sb") >= least).drop("sa", "sb")
        links = self.scratch.keep(confirmed(self.scratch.keep(near, "near"), self.texts, self.words, self.percent), "links")
        if links.isEmpty():
            return
        ends = links.join(self.labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(self.labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        new = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), self.scratch).select(F.col("node").alias("label"), F.col("label").alias("new"))
        self.labels = self.scratch.keep(self.labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        self.found = True


def shared_keys(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node) of the band keys that more than one class has.

    The keys that several classes have go into a bit table of fixed size, so
    that only they, and few others, are dealt out a second time.
    """
    counts = classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = scratch.keep(counts, "shared")
    table = classes.sparkSession.sparkContext.broadcast(bit_table(shared, "key"))

    def run(batches):
        for batch in batches:
            bands = batch.column(1)
            keys = bands.flatten().to_numpy()
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(bands.offsets.to_numpy()))
            hit = in_table(table.value, keys.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(nodes[hit])], names=["key", "node"])

    maybe = classes.select("node", "bands").mapInArrow(tidied(run), "key long, node long")
    return scratch.keep(maybe.join(shared, "key"), "members")


def wanted_texts(docs: DataFrame, wanted: DataFrame, text_col: str, scratch: Scratch) -> DataFrame:
    """(t1, t2, t): one text for each pair of text hashes in ``wanted``; a bit table of fixed size keeps most others from the shuffle."""
    wanted = scratch.keep(wanted, "wanted")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "t1"))

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            t1 = batch.column(0).to_numpy()
            hit = in_table(table.value, t1.view(np.uint64))
            for i in np.flatnonzero(hit):  # copies in one task go once
                if (k := int(t1[i])) in sent:
                    hit[i] = False
                elif len(sent) < 1_000_000:
                    sent.add(k)
            yield batch.filter(pa.array(hit))

    texts = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2"), F.col(text_col).alias("t"))
    found = texts.mapInArrow(tidied(run), "t1 long, t2 long, t string").join(wanted, ["t1", "t2"])
    return scratch.keep(found.groupBy("t1", "t2").agg(F.min("t").alias("t")), "texts")


def prefix_rows(nodes: DataFrame, of_class: DataFrame, texts: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """(key, bin, node, label, n, most, home): the rows on which the classes ``nodes`` (node, label) can meet.

    A set of n shingles, rarest first, whose shingle p is the first that it
    shares with a partner, shares at most n - p; so the partner has at most
    ``most`` = (100 + percent) (n - p) / percent - n shingles. Rows of the
    smaller partner are ``home`` in the bin of its size, those of the larger
    visit the bins of all sizes that it may meet.
    """
    asked = nodes.join(of_class.select("node", "t1", "t2"), "node").join(texts, ["t1", "t2"]).select("node", "label", "t")

    def run(batches):
        signer = Signer(words)
        for batch in batches:
            sets = [s for some in signer.shingles(batch.column(2)) for s in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "label", "s"])

    sets = scratch.keep(asked.mapInArrow(tidied(run), "node long, label long, s array<long>"), "sets")
    each = sets.select("node", F.explode("s").alias("key"))
    often = scratch.keep(each.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "often")
    ranked = scratch.keep(each.join(often, "key"), "ranked").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "key"))).alias("r"))
    sized = sets.select("node", "label", F.size("s").cast("long").alias("n"))
    # shingles of no other set come first; from the first shared one on, size(r) - pos are left
    most = F.expr(f"(({100 + percent}L * (size(r) - pos)) div {percent}L) - n")
    rows = scratch.keep(ranked, "by_node").join(sized, "node").select("node", "label", "n", "r", F.posexplode("r").alias("pos", "x")).withColumn("most", most)
    smallest = F.expr(f"(n * {percent}L + 99) div 100")
    rows = rows.filter(F.col("most") >= smallest).select("node", "label", "n", "most", F.col("x.key").alias("key"), smallest.alias("smallest"))
    bin_of = lambda c: F.floor(F.log(c) * 50).cast("int")  # noqa: E731  sizes within two per cent
    rows = rows.withColumn("bin", F.explode(F.sequence(bin_of(F.col("smallest")), bin_of(F.least("n", "most")))))
    return scratch.keep(rows.select("key", "bin", "node", "label", "n", "most", ((F.col("most") >= F.col("n")) & (F.col("bin") == bin_of(F.col("n")))).alias("home")), "prefix_rows")


def prefix_pairs(rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet on a row and keep the length and positional bounds.

    In each bucket the members outside its most frequent component look for
    partners; buckets of one component make no pairs.
    """
    by_label = rows.groupBy("key", "bin", "label").agg(F.count("*").alias("k"), F.max("home").alias("home"))
    buckets = by_label.groupBy("key", "bin").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels"), F.max("home").alias("home"))
    buckets = scratch.keep(buckets.filter("labels > 1 and home").select("key", "bin", F.col("top.label").alias("top")), "buckets")
    members = scratch.keep(rows.join(buckets, ["key", "bin"]), "bucket_members")
    seek = members.filter("label <> top").select("key", "bin", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "most", "home")])
    both = members.drop("top").join(seek, ["key", "bin"]).filter(
        f"label <> label_a and (home or home_a) and n <= most_a and n_a <= most and 100 * least(n, n_a) >= {percent} * greatest(n, n_a)"
    )
    return both.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct()


def class_links(classes: DataFrame, docs: DataFrame, text_col: str, scratch: Scratch, words: int, percent: int) -> DataFrame | None:
    """node -> label for the classes that share a band with another; None when no two are linked."""
    members = shared_keys(classes, scratch)
    nodes = scratch.keep(members.groupBy("node").agg(F.sum("size").alias("weight")), "nodes")
    if nodes.isEmpty():
        return None
    of_class = scratch.keep(classes.join(nodes.select("node"), "node").select("node", "t1", "t2", "sketch"), "of_class")
    texts = wanted_texts(docs, of_class.select("t1", "t2").distinct(), text_col, scratch)
    links = _Links(of_class, texts, nodes, scratch, words, percent)
    # the member that meets most others is the likeliest centre of its bucket
    weighed = scratch.keep(members.drop("size").join(nodes, "node"), "weighed")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("back"))).alias("p")).select("key", (-F.col("p.back")).alias("a"))
    pivots = scratch.keep(pivots, "pivots")
    pairs = weighed.join(pivots, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    links.test(scratch.keep(pairs, "pairs"))
    # the rest: members that differ from each other in component, the pivot aside (it met all)
    rest = scratch.keep(weighed.join(pivots, "key").filter("node <> a").join(links.labels, "node").select("key", "node", "label"), "rest")
    unsettled = scratch.keep(rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key"), "open")
    left = scratch.keep(rest.join(unsettled, "key").select("node", "label").distinct(), "left")
    if not left.isEmpty():
        rows = prefix_rows(left, of_class, texts, scratch, words, percent)
        links.test(scratch.keep(prefix_pairs(rows, scratch, percent), "prefix_pairs"))
    return links.labels if links.found else None


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of documents.

    Two documents are linked when their sets of ``words``-word shingles (words
    are runs without ASCII white space, A-Z in lower case; a text with fewer
    words is one shingle) have 100 * intersection >= percent * union.

    One row per input row: id, n_shingles, component_id (smallest id reachable,
    its own included), kept (id = component_id). A null or wordless text has an
    empty set, is linked with nothing and kept. Repeated rows are all kept or
    all not. A null id counts only where its component has no other: then
    component_id is null and kept is true. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(signatures(docs, words, id_col, text_col), "signatures")
    same = ["set_hi", "set_lo", "n_shingles"]
    classes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.first(F.struct("t1", "t2", "bands", "sketch")).alias("one"))
    classes = scratch.keep(classes.select(*same, "rep", "one.*", F.monotonically_increasing_id().alias("node")), "classes")
    labels = class_links(classes, docs, text_col, scratch, words, percent)
    if labels is None:
        groups = classes.select(*same, F.col("rep").alias("component_id"))
    else:
        labels = scratch.keep(classes.select("node", "rep", *same).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        least = scratch.keep(labels.groupBy("label").agg(F.min("rep").alias("component_id")), "components")
        groups = labels.join(least, "label").select(*same, "component_id")
    groups = scratch.keep(groups, "groups")
    scratch.drop_all_but("signatures", "groups")
    alone = signed.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    rows = signed.filter("n_shingles > 0").select("id", *same).join(groups, same).select("id", "n_shingles", "component_id").union(alone)
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
