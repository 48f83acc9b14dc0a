"""Phrase collocations by dynamic itemset counting.

The documents lie in SHARDS shards, which are scanned in turn, round and round.
Words are counted from the first step on. A longer phrase is counted from the
step after both its subphrases (without its last and without its first word)
have reached the threshold, and for one full cycle, so that it meets every
shard once; lengths are thereby interleaved, and counting ends when no phrase is
left in its cycle.

* While phrases come and go they are known by 64-bit hashes, so that a step
  shuffles two numbers a phrase. Equal hashes could only let a phrase pass that
  isn't frequent; one last scan counts the phrases that passed by their words.
* Which phrases are counted is decided in the scan by two bit tables of fixed
  size (phrases that reached the threshold, and those that did so within the
  last cycle); a bit too many costs counting, never a wrong count, and when the
  tables fill, semi-joins stand behind them.
* Any SHARDS steps in a row meet each shard once, so a phrase's count over the
  last cycle is the sum of its last SHARDS step tables. Only phrases with a
  SHARDS-th of the threshold in some step can reach it, so only those are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from alertspark.llm.common import TABLE_BITS, Scratch, WordHasher, bit_table, in_table, mix, slices, text_buffers, tidied

SHARDS = 3
#: Bytes of text worked on at once, in the cyclic scans and in the last one; phrases counted together before they leave
#: a task, rows that leave it at once.
AT_ONCE, LAST_AT_ONCE, HELD, SPELLED = 1 << 20, 1 << 22, 1 << 19, 1 << 15
#: Share of set bits above which the scan's choice is checked by joins.
FULL = 0.25
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\v\f\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True


def _spans(texts: pa.Array, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, documents): whole texts some at a time; a long one is cut behind a break, where no phrase is cut."""
    data, off = text_buffers(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + at_once, "right")) - 1))
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= at_once:
            yield data[lo:hi], off[i + 1 : j + 1] - lo, np.arange(i, j)
        while hi - lo > at_once:  # one long text
            cut, step = lo + at_once, 1 << 12
            while cut < hi:
                found = np.flatnonzero(_BREAK[data[cut : cut + step]])
                if len(found):
                    cut += int(found[0]) + 1
                    break
                cut, step = cut + step, 2 * step
            cut = min(cut, hi)
            yield data[lo:cut], np.array([cut - lo]), np.array([i])
            lo = cut
            if hi - lo <= at_once:
                yield data[lo:hi], np.array([hi - lo]), np.array([i])
        i = j


def _marked(h: np.ndarray, k: int) -> np.ndarray:
    """A hash with the number of words in its four highest bits."""
    return h >> np.uint64(4) | np.uint64(k << 60)


class Span:
    """Words of a span: place in the piece, language, and hashes of the phrases that end there."""

    def __init__(self, hasher: WordHasher, data: np.ndarray, ends: np.ndarray, lang: np.ndarray, lang_hash: np.ndarray, named: bool = False):
        if named:
            start = self._name_words(hasher, data, ends)
        else:
            _, start, _, self.own = hasher.piece(data, ends)
        doc = np.searchsorted(ends, start, "right")
        # a piece begins behind a break and with a document
        part = np.cumsum(_BREAK[data], dtype=np.int32)[start] + doc
        at = np.arange(len(part))
        first = np.ones(len(part), bool)
        first[1:] = part[1:] != part[:-1]
        self.place = at - np.maximum.accumulate(np.where(first, at, 0))
        self.lang = lang[doc]
        self.hash = _marked(mix(self.own ^ lang_hash[self.lang]), 1)

    def _name_words(self, hasher: WordHasher, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number the distinct words, hash these alone, and lay them out again, each followed by one space; the words' starts."""
        low = hasher.lower[data]
        word = ~_GAP[low]
        edge = np.diff(word, prepend=False)
        cut = ends[(ends > 0) & (ends < len(low))]
        edge[cut[word[cut]]] = True  # where a document begins with a word
        start = np.flatnonzero(edge & word)
        closed = np.append(edge | ~word, True)
        closed[cut[word[cut - 1]]] = True
        end = np.flatnonzero(closed[1:] & word) + 1
        both = np.empty(2 * len(start), np.int64)
        both[0::2], both[1::2] = start, end
        pieces = pa.Array.from_buffers(pa.large_binary(), max(0, len(both) - 1), [None, pa.py_buffer(both), pa.py_buffer(low)])
        found = pieces.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        self.code = found.indices.to_numpy()
        size = np.fromiter((len(w) + 1 for w in distinct), np.int64, len(distinct))
        self.flat = np.frombuffer(b"".join(w + b" " for w in distinct), np.uint8)
        self.at, self.size = (np.cumsum(size) - size)[self.code], size[self.code]
        self.own = hasher.piece(self.flat, np.zeros(0, np.int64))[3][self.code] if distinct else np.zeros(0, np.uint64)
        return start

    def grow(self, k: int, prefix: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of k words by their last word; ``prefix`` are those of k - 1 words."""
        out = np.zeros_like(prefix)
        out[1:] = _marked(mix(prefix[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.own[1:]), k)
        return out

    def __iter__(self):
        """(k, hashes of the phrases of k - 1 words, and of k words) for k = 1, 2, ..."""
        k, before, hashes = 1, self.hash, self.hash
        while True:
            yield k, before, hashes
            k, before = k + 1, hashes
            hashes = self.grow(k, hashes)

    def groups(self, k: int, last: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word of one phrase of each kind and how often each occurs; equal hashes are checked word by word."""
        _, one, which, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        rep = last[one][which]
        same = self.lang[last] == self.lang[rep]
        for i in range(k):
            same &= self.code[last - i] == self.code[rep - i]
        if same.all():
            return last[one], count
        group = self.lang[last].astype(np.int64)  # two phrases of one hash: by the words themselves
        for i in range(k):
            _, group = np.unique(group * (int(self.code.max()) + 1) + self.code[last - i], return_inverse=True)
        _, one, count = np.unique(group, return_index=True, return_counts=True)
        return last[one], count

    def spell(self, k: int, last: np.ndarray) -> pa.Array:
        word = (last[:, None] - np.arange(k - 1, -1, -1)).ravel()
        n, at = self.size[word], self.at[word]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        phrase_ends = ends[k - 1 :: k]
        keep = np.ones(len(flat), bool)
        keep[phrase_ends - 1] = False  # the space behind a phrase
        offsets = np.concatenate([[0], phrase_ends - np.arange(1, len(phrase_ends) + 1)])
        return pa.Array.from_buffers(pa.large_string(), len(last), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat[keep])]).cast(pa.string())


def _read(hasher: WordHasher, batch: pa.RecordBatch, at_once: int, named: bool = False) -> Iterator[tuple[Span, list[str]]]:
    langs = batch.column(0).dictionary_encode()
    names = langs.dictionary.to_pylist()
    code, lang_hash = langs.indices.to_numpy(), np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in names], np.uint64)
    for data, ends, docs in _spans(batch.column(1), at_once):
        yield Span(hasher, data, ends, code[docs], lang_hash, named), names


def step_counts(shard: DataFrame, words: bool, tables, longest: int, parts: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """Hashes of the phrases of a shard (lang, text) that are counted in this step, with their counts within a part of a task.

    ``words``: whether single words are counted; ``tables``: broadcast (reached,
    reached within the last cycle, lengths of the latter) or None; ``parts``: also the hashes of the
    phrase without its last and without its first word.
    """

    def merged(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, first, rest = (np.concatenate(a) for a in zip(*held))
        h, one, c = np.unique(h, return_index=True, return_counts=True)
        cols = [pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))] + [pa.array(a[one].view(np.int64)) for a in (first, rest) if parts]
        return pa.RecordBatch.from_arrays(cols, names=["h", "c", "first", "rest"][: len(cols)])

    def count(batches):
        reached, recent, lengths = tables.value if tables is not None else (None, None, ())
        held, n, hasher = [], 0, WordHasher(~_GAP)
        for span in (span for batch in batches for span, _ in _read(hasher, batch, at_once)):
            for k, before, hashes in span:
                if k == 1:
                    last = np.arange(len(hashes)) if words else np.zeros(0, np.int64)
                elif k > longest or k - 1 > max(lengths, default=0):
                    break
                elif k - 1 not in lengths:
                    continue
                else:
                    known = in_table(reached, before)
                    last = np.flatnonzero(known[1:] & known[:-1] & (span.place[1:] >= k - 1)) + 1
                    if not len(last):
                        break
                    last = last[in_table(recent, before[last]) | in_table(recent, before[last - 1])]
                if len(last):
                    held.append((hashes[last], before[last - 1] if parts and k > 1 else hashes[last], before[last]))
                    n += len(last)
                if n >= HELD:
                    yield from slices(merged(held), SPELLED)
                    held, n = [], 0
        if held:
            yield from slices(merged(held), SPELLED)

    return shard.select("lang", "text").mapInArrow(tidied(count), "h bigint, c bigint" + ", first bigint, rest bigint" * parts)


def spelled_counts(docs: DataFrame, passed, longest: int, at_once: int = LAST_AT_ONCE) -> DataFrame:
    """(lang, phrase, k, c): the phrases whose hashes are in the broadcast bit table, counted by their words; k = 0 counts a language's words."""

    def count(batches):
        table, hasher = passed.value, WordHasher(~_GAP)
        for batch in batches:
            for span, names in _read(hasher, batch, at_once, named=True):
                lang_of = pa.array(names, pa.string())
                per_lang = np.bincount(span.lang, minlength=len(names))
                yield pa.RecordBatch.from_arrays([lang_of, pa.array([""] * len(names)), pa.array(np.zeros(len(names), np.int32)), pa.array(per_lang.astype(np.int64))], names=["lang", "phrase", "k", "c"])
                for k, before, hashes in span:
                    if k > longest:
                        break
                    last = np.flatnonzero((span.place >= k - 1) & in_table(table, hashes))
                    if not len(last):
                        break
                    last, c = span.groups(k, last, hashes[last])
                    for i in range(0, len(last), SPELLED):
                        some = last[i : i + SPELLED]
                        cols = [lang_of.take(pa.array(span.lang[some])), span.spell(k, some), pa.array(np.full(len(some), k, np.int32)), pa.array(c[i : i + SPELLED].astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(cols, names=["lang", "phrase", "k", "c"])

    return docs.select("lang", "text").mapInArrow(tidied(count), "lang string, phrase string, k int, c bigint")


def passing(home: str, docs: DataFrame, least: int, longest: int, shards: int, scratch: Scratch) -> np.ndarray:
    """The cyclic scans over the shards in ``home``: a bit table of the phrases that reached the threshold."""
    spark, share = docs.sparkSession, -(-least // shards)
    counts: list[list[str]] = []  # folders of the last steps' tables; big=1 holds what may reach the threshold
    reached: list[str] = []
    bits: list[np.ndarray] = []  # of what each step of the last cycle was the first to see reach the threshold
    lengths: list[set[int]] = []  # and how many words it has
    known = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    read = lambda folders, *cols: spark.read.schema("h bigint, c bigint, f bigint").parquet(*folders).select(*cols)
    step = 0
    while step < shards or any(b.any() for b in bits):
        shard = spark.read.schema("lang string, text string, shard int").parquet(home).filter(F.col("shard") == step % shards)
        recent = reduce(np.bitwise_or, bits) if bits else known
        tables = spark.sparkContext.broadcast((known, recent, set().union(*lengths))) if recent.any() else None
        full = bool(np.bitwise_count(known).sum() > FULL * (1 << TABLE_BITS))
        rows = step_counts(shard, step < shards, tables, longest, full)
        if full:
            rows = _truly_counted(rows, read(reached, "h"))
        path = scratch.write(rows.groupBy("h").agg(F.sum("c").alias("c")).withColumn("big", (F.col("c") >= share).cast("int")), f"step{step}", "big")
        counts = [*counts, [f for f in (f"{path}/big=0", f"{path}/big=1") if scratch.exists(f)]][-shards:]
        if tables is not None:
            tables.destroy()
        big, new, sizes = [f for some in counts for f in some if f.endswith("1")], np.zeros_like(known), set()
        if big:
            followed = spark.sparkContext.broadcast(bit_table(read(big, "h"), "h"))
            window = _within(read([f for some in counts for f in some], "h", "c"), followed)
            sums = window.groupBy("h").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
            first = scratch.keep(sums.join(read(reached, "h"), "h", "left_anti") if reached else sums, "reached")
            reached.append(scratch.paths["reached"][-1])
            followed.destroy()
            sizes = {r[0] for r in first.select(F.shiftright("h", 60)).distinct().collect()} - {longest}
            new = bit_table(first.filter(F.shiftright("h", 60) < longest), "h") if sizes else new
        bits, lengths = [*bits, new][-shards:], [*lengths, sizes][-shards:]
        known = known | new
        if step >= shards - 1:  # behind the next step's window
            scratch.drop(f"step{step - shards + 1}")
        step += 1
    return bit_table(read(reached, "h"), "h") if reached else known


def _within(rows: DataFrame, table) -> DataFrame:
    """The rows (h, c) whose hash is in the broadcast bit table: those of the phrases put in, and few others."""

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_table(table.value, batch.column(0).to_numpy().view(np.uint64))))

    return rows.mapInArrow(tidied(keep), "h bigint, c bigint")


def _truly_counted(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """Words, and the phrases whose subphrases did reach the threshold."""
    word = F.shiftright("h", 60) == 1
    longer = rows.filter(~word)
    for part in ("first", "rest"):
        longer = longer.join(reached.select(F.col("h").alias(part)), part, "left_semi")
    return rows.filter(word).unionByName(longer)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words with f >= least, and (lang, n) with the words of each language."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    if not 1 <= longest <= 7:
        raise ValueError("longest must be from 1 to 7")
    dealt = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    home = scratch.write(dealt, "shards", "shard")
    passed = spark.sparkContext.broadcast(passing(home, dealt, least, longest, shards, scratch))
    rows = spelled_counts(spark.read.schema("lang string, text string, shard int").parquet(home), passed, longest)
    total = rows.groupBy("lang", "phrase", "k").agg(F.sum("c").alias("f"))
    out = scratch.keep(total.filter((F.col("f") >= least) | (F.col("k") == 0)), "frequent")
    scratch.drop_all_but("frequent")
    return out.filter("k > 0"), out.filter("k = 0 and f > 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The best-scoring phrases of each language.

    Candidates are the phrases of 2 to ``longest`` words that occur at least
    ``least`` times in a language; a phrase lies within a piece between
    ``.,;:!?`` and line ends. Cutting one into l and r occurrences of its two
    parts scores floor(1000 a n / (l r)); the lowest cut counts, ties to the
    shortest first part. A candidate goes if a longer one that holds it occurs
    at least ``percent`` % as often. Per language, the first ``top`` by score
    and a (descending) and phrase come back: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language ``und``; repeated rows count again;
    an empty table gives no rows; other columns are not read. Counts are exact
    sums, scores are computed in 38 digits.
    """
    frequent, n = frequent_phrases(docs, least, longest, shards, lang_col, text_col)
    words = F.split("phrase", " ")
    candidates = frequent.filter("k > 1").withColumn("words", words)
    part = lambda a, m: F.array_join(F.slice("words", a, m), " ")
    cuts = candidates.select("lang", "phrase", "k", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(n, "lang").withColumn("over", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(19,0)") * wide("n")).withColumn("under", wide("l") * wide("r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("b"))
    inner = candidates.filter("k > 2").select("lang", "words", "k", F.col("f").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "words", "k", "longer", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("from"))
    inner = inner.select("lang", part(F.col("from"), F.col("m")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
