"""Helpers shared by the text operators: written tables and byte-level words.

The word rules of the operators only name ASCII separators, so words can be
found on the UTF-8 bytes: a byte of a multi-byte character is always >= 0x80
and never a separator.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertspark.session import shared_path

#: Bytes of text worked on at once; a longer document is worked in pieces cut at separators.
PIECE = 1 << 20
#: Bits of a table that is broadcast: 8 MB, whatever the number of keys.
TABLE_BITS = 26
_WS = b" \t\n\v\f\r"


class Scratch:
    """Tables written under the shared checkpoint folder of the session.

    Each cuts the lineage at Parquet files that every executor can read again,
    so a lost executor costs a re-read and never the work above.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write(self, df: DataFrame, name: str, by: str) -> str:
        """Write a table in folders by a column; its path."""
        path = shared_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        df.write.partitionBy(by).parquet(path)
        return path

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names; call it when no plan in use reads them."""
        for name in names:
            for path in self.paths.pop(name, []):
                fs, p = self._at(path)
                fs.delete(p, True)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """The long keys as a bit table of fixed size; built by Spark, at most 2^TABLE_BITS / 64 rows reach the driver.

    It may hold keys that weren't put in, never lacks one that was; a fuller
    table lets more rows through to the join behind it.
    """
    at = F.expr(f"{column} & {(1 << TABLE_BITS) - 1}L")
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    got = words.toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return table.view(np.uint8)


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << TABLE_BITS) - 1)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def spaced_words() -> np.ndarray:
    """Byte table of the words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[list(_WS)] = False
    return t


def alnum_words() -> np.ndarray:
    """Byte table of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (text in lower case)."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of the documents ``first .. first+len(at)-2`` of a batch; ``at[i]:at[i+1]`` are document i's."""

    first: int
    hashes: np.ndarray
    at: np.ndarray
    spans: list[tuple[bytes, np.ndarray, np.ndarray]]

    def text(self, k: int) -> bytes:
        """Word ``k`` in lower case."""
        for data, start, end in self.spans:
            if k < len(start):
                return data[start[k] : end[k]]
            k -= len(start)
        raise IndexError(k)


class WordHasher:
    """64-bit hashes of all words of a batch of texts, by prefix sums over its bytes.

    A word's hash is the sum of (random value of byte) * P^(place in the word)
    mod 2^64, then mixed with its length; it depends on the word alone.
    """

    def __init__(self, table: np.ndarray, seed: int = 20240229):
        rng = np.random.default_rng(seed)
        self.lower = lower_table()
        self.is_word = table
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.p = 0x5851F42D4C957F2D
        self.pow = self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            size = max(n, PIECE + 1)
            for name, base in (("pow", self.p), ("inv", pow(self.p, -1, 1 << 64))):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def piece(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-case bytes, word starts, word ends, word hashes); no word crosses a cut."""
        n = len(data)
        low = self.lower[data]
        if not n:
            return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self._powers(n + 1)
        w = self.is_word[low]
        head, tail = w.copy(), w.copy()
        head[1:] &= ~w[:-1]
        tail[:-1] &= ~w[1:]
        c = cuts[(cuts > 0) & (cuts < n)]
        head[c] = w[c]
        tail[c - 1] = w[c - 1]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[low] * self.pow[:n], out=total[1:])
        h = (total[end] - total[start]) * self.inv[start]
        return low, start, end, mix(h + (end - start).astype(np.uint64))

    def batches(self, texts: pa.Array, keep_text: bool = False) -> Iterator[Words]:
        """Words of every text (null: none), some documents at a time."""
        data, off = text_buffers(texts)
        n, i = len(off) - 1, 0
        while i < n:
            j = int(np.searchsorted(off, off[i] + PIECE, "right")) - 1
            j = min(n, max(j, i + 1))
            lo, hi = int(off[i]), int(off[j])
            if hi - lo <= PIECE:
                low, s, e, h = self.piece(data[lo:hi], off[i : j + 1] - lo)
                yield Words(i, h, np.searchsorted(s, off[i : j + 1] - lo), [(low.tobytes(), s, e)] if keep_text else [])
            else:
                parts = [self.piece(data[a:b], np.zeros(0, np.int64)) for a, b in self._pieces(data, lo, hi)]
                h = np.concatenate([p[3] for p in parts])
                yield Words(i, h, np.array([0, len(h)]), [(p[0].tobytes(), p[1], p[2]) for p in parts] if keep_text else [])
            i = j

    def _pieces(self, data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        while lo < hi:
            cut = min(lo + PIECE, hi)
            step = 4096
            while cut < hi:  # the next separator, so that no word is cut
                gap = np.flatnonzero(~self.is_word[self.lower[data[cut : cut + step]]])
                if len(gap):
                    cut += int(gap[0])
                    break
                cut = min(cut + step, hi)
                step *= 2
            yield lo, cut
            lo = cut


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its offsets (null: empty), without a copy per row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = texts.buffers()[2]
    return (np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)), off


def tidied(work: Callable) -> Callable:
    """A function over Arrow batches that hands its memory back to the system when the task ends.

    Python workers live on from stage to stage; without this each keeps what
    the largest of its tasks once held.
    """

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:
                pass  # another C library

    return run


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
