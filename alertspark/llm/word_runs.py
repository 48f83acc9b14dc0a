"""Periodic runs of words: difference-cover LCE driving a harmonic-grid enumeration.

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)``
words long, that no neighbouring word extends keeping period q.

* Grid: a run of period q covers a place i = 0, q, 2q, ... whose stretch to the
  left stays below q; so the pairs (i, i + q) over all q, n/1 + n/2 + ... of
  them, meet every run. The longest common extensions of a pair to the right
  and to the left are its run.
* LCE: only suffixes at places of a difference cover are sorted. For any two
  places a shift below the cover's modulus takes both into the cover, so some
  words are compared one by one and the rest is the minimum of the adjacent
  common prefixes between two ranks: a range-minimum query on a sparse table.

Documents are worked on some at a time, one after the other with a word of its
own kind between them, so no common extension leaves a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from alertspark.llm.common import PIECE, spaced_words, text_buffers

#: A difference cover (fixed values): every number mod 31 is the difference of two of these six.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Pairs of places whose common extensions are looked up at once.
PAIRS = 1 << 18


def shifts(modulus: int = MODULUS, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """``shifts[i % m, (j - i) % m]``: the least k that takes i + k and j + k into the cover."""
    member = np.isin(np.arange(modulus), cover)
    i, d, k = np.ogrid[:modulus, :modulus, :modulus]
    both = member[(i + k) % modulus] & member[(i + d + k) % modulus]
    assert both.any(axis=2).all()
    return both.argmax(axis=2)


_SHIFT = shifts()


class CoverLce:
    """Longest common extensions of any two places of ``words``; its last word must occur nowhere else."""

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        of_class = [np.arange(d, n, MODULUS) for d in COVER]
        self.first = np.zeros(MODULUS, np.int64)
        self.first[list(COVER)] = np.cumsum([0, *map(len, of_class[:-1])])
        places = np.concatenate(of_class)
        levels = self._sort(places)
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        self._adjacent(places, order, levels)

    def _sort(self, places: np.ndarray) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first m, 2 m, 4 m, ... words until all differ (m: the modulus).

        A rank is the number of smaller suffixes; only what is still tied is sorted again.
        """
        m = len(places)
        rank, tied = np.zeros(m, np.int64), np.arange(m)
        padded = np.concatenate([self.words.astype(np.int64) + 1, np.zeros(MODULUS, np.int64)])
        bits = max(1, int(padded.max()).bit_length())
        room = max(1, 62 // bits)
        for k in range(0, MODULUS, room):
            key = np.zeros(len(tied), np.int64)
            for j in range(k, min(k + room, MODULUS)):
                key = key << bits | padded[places[tied] + j]
            tied = _refine(rank, tied, key)
        levels, step = [rank.copy()], 1
        while len(tied):
            tied = _refine(rank, tied, rank[np.minimum(tied + step, m - 1)])
            levels.append(rank.copy())
            step *= 2
        return levels

    def _adjacent(self, places: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in rank order, and the sparse table of their minima."""
        x, y = order[:-1].copy(), order[1:].copy()
        same = np.zeros(len(x), np.int64)
        last = len(order) - 1
        for k in range(len(levels) - 1, -1, -1):
            at_x, at_y = np.minimum(x, last), np.minimum(y, last)
            equal = (levels[k][at_x] == levels[k][at_y]) & (x <= last) & (y <= last)
            step = equal << k
            x, y, same = x + step, y + step, same + step
        p, q = places[order[:-1]] + same * MODULUS, places[order[1:]] + same * MODULUS
        lcp = same * MODULUS + self._compare(p, q, np.full(len(p), MODULUS))
        self.minima = [lcp.astype(np.int32)]
        while 2 << (len(self.minima) - 1) <= len(lcp):
            a, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(a[:-half], a[half:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, at most ``most`` of them."""
        out = np.zeros(len(i), np.int64)
        live, k, last = np.arange(len(i)), 0, len(self.words) - 1
        while len(live):
            live = live[most[live] > k]
            a, b = i[live] + k, j[live] + k
            live = live[(a <= last) & (b <= last) & (self.words[np.minimum(a, last)] == self.words[np.minimum(b, last)])]
            k += 1
            out[live] = k
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = _SHIFT[i % MODULUS, (j - i) % MODULUS]
        out = self._compare(i, j, shift)
        far = np.flatnonzero(out == shift)
        a, b = i[far] + shift[far], j[far] + shift[far]
        a, b = (self.rank[self.first[p % MODULUS] + p // MODULUS] for p in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1  # the largest power of two that fits
        for k in np.unique(level):
            at = level == k
            table = self.minima[k]
            out[far[at]] += np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def _refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by ``key`` (one for each of ``tied``); what is still tied."""
    if not len(tied):
        return tied
    order = np.lexsort((key, rank[tied]))
    t, k = tied[order], key[order]
    r, at = rank[t], np.arange(len(t))
    group = np.concatenate([[True], r[1:] != r[:-1]])
    part = group | np.concatenate([[True], k[1:] != k[:-1]])
    rank[t] = r + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    return t[~(part & np.concatenate([part[1:], [True]]))]


def runs(words: np.ndarray, lengths: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period.

    ``words``: the documents' word numbers (from 0) end to end; ``lengths``:
    how many each has. A run has at least ``max(least, times * period)`` words; times >= 3.
    """
    by_size = np.argsort(-lengths, kind="stable")  # so that those long enough for a period come first
    size = lengths[by_size]
    first = np.cumsum(size + 1) - size  # a word of its own before each document and after the last
    seq = np.empty(int(size.sum()) + len(size) + 1, np.int64)
    edge = np.concatenate([first - 1, [len(seq) - 1]])
    seq[edge] = int(words.max(initial=-1)) + 1 + np.arange(len(edge))
    inner = np.ones(len(seq), bool)
    inner[edge] = False
    starts = np.cumsum(lengths) - lengths
    seq[inner] = words[np.repeat(starts[by_size] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    right, left, found = None, None, []
    for i, q in _grid(seq, first + size, size, least, times):
        if right is None:
            right = CoverLce(seq)
        need = np.maximum(least, times * q)
        ahead = right(i, i + q)
        some = ahead > need - 2 * q  # the first place of the grid in its run has fewer than q words before it
        i, q, need, ahead = i[some], q[some], need[some], ahead[some]
        if not len(i):
            continue
        if left is None:
            left = CoverLce(seq[::-1].copy())
        before = left(len(seq) - i - q, len(seq) - i)
        some = (before < q) & (before + q + ahead >= need)
        if some.any():
            found.append(np.stack([(i - before)[some], (before + q + ahead)[some], q[some]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    s, n, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, n, s))
    s, n, q = s[order], n[order], q[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])  # a multiple of a run's period gives the same stretch
    s, n, q = s[new], n[new], q[new]
    doc = np.searchsorted(first, s, "right") - 1
    start = s - first[doc]
    doc = by_size[doc]
    order = np.lexsort((q, start, doc))
    return doc[order], start[order], n[order], q[order]


def _grid(seq: np.ndarray, ends: np.ndarray, size: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i = 0, q, 2 q, ... whose word is that at i + q, with q, some at a time."""
    held, n, q = [], 0, 1
    while True:
        fit = int(np.searchsorted(-size, -max(least, times * q), "right"))
        if not fit:
            break
        part = seq[: ends[fit - 1]]
        i = np.flatnonzero(part[: len(part) - q : q] == part[q::q]) * q
        if len(i):
            held.append((i, q))
            n += len(i)
        if n >= PAIRS:
            yield from _packed(held)
            held, n = [], 0
        q += 1
    yield from _packed(held)


def _packed(held: list[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if held:
        i = np.concatenate([a for a, _ in held])
        q = np.repeat(np.array([q for _, q in held]), [len(a) for a, _ in held])
        for k in range(0, len(i), PAIRS):
            yield i[k : k + PAIRS], q[k : k + PAIRS]


@dataclass
class Texts:
    """Documents of a batch as word numbers; ``spelled`` and ``lengths`` are the distinct words' bytes, each followed by a space."""

    first: int
    words: list[np.ndarray]
    spelled: np.ndarray
    lengths: np.ndarray

    def join(self, words: np.ndarray) -> np.ndarray:
        n = self.lengths[words]
        ends = np.cumsum(n)
        starts = np.cumsum(self.lengths) - self.lengths
        return self.spelled[np.repeat(starts[words] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


_IS_WORD = spaced_words()


def read_words(texts: pa.Array, at_once: int = PIECE) -> Iterator[Texts]:
    """Whole texts as words, documents of about ``at_once`` bytes at a time; a longer one alone."""
    data, off = text_buffers(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + at_once, "right")) - 1))
        some, ends = data[off[i] : off[j]], off[i : j + 1] - off[i]
        word = _IS_WORD[some]
        head, tail = word.copy(), word.copy()
        head[1:] &= ~word[:-1]
        tail[:-1] &= ~word[1:]
        cut = ends[(ends > 0) & (ends < len(some))]
        head[cut], tail[cut - 1] = word[cut], word[cut - 1]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        # words and gaps in turn, so that one offsets array names them all
        both = np.empty(2 * len(start), np.int64)
        both[0::2], both[1::2] = start, end
        pieces = pa.Array.from_buffers(pa.large_binary(), max(0, len(both) - 1), [None, pa.py_buffer(both), pa.py_buffer(np.ascontiguousarray(some))])
        found = pieces.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
        codes = found.indices.to_numpy().astype(np.int64)
        spelled = [w + b" " for w in found.dictionary.to_pylist()]
        at = np.searchsorted(start, ends)
        yield Texts(i, np.split(codes, at[1:-1]), np.frombuffer(b"".join(spelled), np.uint8), np.fromiter(map(len, spelled), np.int64, len(spelled)))
        i = j


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, order: Callable[[object, int], np.ndarray | None] | None = None
) -> DataFrame:
    """All runs of each whole text, and the text with every run collapsed to its first period.

    One row per input row: id, n_words, runs (array of start, length, period by
    start, then period), collapsed (the kept words joined by one space; a word
    goes if some run holds it behind that run's first period). ``order(id, n)``
    may name the words to look at instead of the text's own n (their places in
    it, or None). A null or empty text has no words, no runs and an empty
    string; repeated rows give repeated results, a null id stays null, other
    columns are not read. No shuffle; a task holds about a megabyte of text, or
    one longer text, at a time.
    """
    run = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    run_type = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])

    def find(batches):
        for batch in batches:
            for texts in read_words(batch.column(1)):
                ids = batch.column(0).slice(texts.first, len(texts.words))
                if order is not None:
                    for k, key in enumerate(ids.to_pylist()):
                        own = order(key, len(texts.words[k]))
                        if own is not None:
                            texts.words[k] = texts.words[k][own]
                lengths = np.array([len(w) for w in texts.words], np.int64)
                words, ends = np.concatenate(texts.words), np.cumsum(lengths)
                doc, s, n, q = runs(words, lengths, least, times)
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, ends[doc] - lengths[doc] + s + q, 1)
                np.add.at(mark, ends[doc] - lengths[doc] + s + n, -1)
                keep = np.cumsum(mark[:-1]) == 0
                kept = words[keep]
                data = texts.join(kept)
                bytes_to = np.concatenate([[0], np.cumsum(texts.lengths[kept])])[np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]]
                collapsed = [data[a : max(a, b - 1)].tobytes() for a, b in zip(bytes_to[:-1], bytes_to[1:])]
                structs = pa.StructArray.from_arrays([pa.array(c) for c in (s, n, q)], fields=list(run_type))
                of_doc = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(lengths) + 1)).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths), of_doc, pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(find, schema)
