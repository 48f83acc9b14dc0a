"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its embedding (a hashed table) beside what a small
bidirectional GRU with attention pooling reads from its characters. A second
bidirectional GRU runs over windows of WINDOW words, each overlapping the next
by half, and attention pools each window into one logit. A document's score is
that of its most toxic window; all windows of the whole text are scored.

The network is fitted on a bounded sample of labelled rows: at most SAMPLE
documents of each class, none longer than SAMPLE_BYTES, all with their whole
text. Only the window that gives a document its score carries any gradient.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertspark.llm.common import PIECE, alnum_words, lower_table, text_buffers

WINDOW, STRIDE = 32, 16
#: A longer word counts as several, so that its characters are all read.
WORD_BYTES = 24
BUCKETS, WORD_DIM, CHAR_DIM, CHAR_UNITS, UNITS, ATTENTION = 1 << 14, 8, 6, 6, 8, 8
#: Bounds of the training sample: documents of each class, bytes of one of them.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 15
STEPS, BATCH, TOXIC, RATE = 400, 32, 10, 0.01
#: Share of the words whose embedding is hidden in a training step (their characters stay); weight decay.
HIDDEN, DECAY = 0.5, 1e-3
#: Labels are not all right: behind the first third, a step weighs each window by its label's probability to this power
#: (generalised cross entropy, Zhang & Sabuncu 2018).
TRUST = 0.7
#: A word has an embedding of its own when so many documents of the sample hold it (fewer in a sample of under ten times
#: as many toxic ones); the others are known by their characters.
OWN_EMBEDDING = 30
#: Every ASIDE-th document of a class is kept for the calibration of the score.
ASIDE = 4
_LOWER, _IS_WORD = lower_table(), alnum_words()
#: Windows (or words) of which the recurrence holds the states at once.
_AT_ONCE = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Both directions of a GRU, then attention over the places. ``w`` (2, in, 3u), ``u`` (2, u, 3u), ``b`` (2, 3u); gates: update, reset, new."""

    def __init__(self, p: dict[str, np.ndarray], name: str):
        self.names = [f"{name}_{k}" for k in ("w", "u", "b", "a", "c", "v")]
        self.w, self.u, self.b, self.a, self.c, self.v = (p[n] for n in self.names)

    @staticmethod
    def new(rng: np.random.Generator, name: str, inputs: int, units: int) -> dict[str, np.ndarray]:
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[-2])).astype(np.float32)
        return {
            f"{name}_w": draw(2, inputs, 3 * units), f"{name}_u": draw(2, units, 3 * units), f"{name}_b": np.zeros((2, 3 * units), np.float32),
            f"{name}_a": draw(2 * units, ATTENTION), f"{name}_c": np.zeros(ATTENTION, np.float32), f"{name}_v": draw(ATTENTION, 1)[:, 0],
        }

    def forward(self, x: np.ndarray, n: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(places, rows, in) and the rows' lengths -> pooled states (rows, 2u); a row of length 0 gives zeros."""
        t, rows, units = x.shape[0], x.shape[1], self.u.shape[1]
        on = np.arange(t)[:, None] < n  # places x rows
        gates = np.matmul(np.stack([x, x[::-1]]).reshape(2, t * rows, -1), self.w).reshape(2, t, rows, 3 * units) + self.b[:, None, None]
        live = np.stack([on, on[::-1]])[..., None].astype(np.float32)
        h = np.zeros((2, rows, units), np.float32)
        hs = np.empty((2, t + 1, rows, units), np.float32)
        hs[:, 0] = h
        if keep is not None:
            keep["g"], keep["an"], keep["new"] = np.empty((2, t, rows, 2 * units), np.float32), np.empty((2, t, rows, units), np.float32), np.empty((2, t, rows, units), np.float32)
        for k in range(t):
            a = np.matmul(h, self.u)
            g = _sigmoid(gates[:, k, :, : 2 * units] + a[..., : 2 * units])
            new = np.tanh(gates[:, k, :, 2 * units :] + g[..., units:] * a[..., 2 * units :])
            h = h + live[:, k] * (1 - g[..., :units]) * (new - h)
            hs[:, k + 1] = h
            if keep is not None:
                keep["g"][:, k], keep["an"][:, k], keep["new"][:, k] = g, a[..., 2 * units :], new
        both = np.concatenate([hs[0, 1:], hs[1, :0:-1]], axis=2)  # places x rows x 2u
        e = np.tanh(both @ self.a + self.c)
        s = np.where(on, e @ self.v, -1e9)
        s = np.exp(s - s.max(axis=0, initial=-1e9)) * on
        s /= np.maximum(s.sum(axis=0), 1e-30)
        if keep is not None:
            keep.update(x=x, live=live, hs=hs, both=both, e=e, s=s)
        return np.einsum("tr,tru->ru", s, both)

    def backward(self, d: np.ndarray, keep: dict, grad: dict[str, np.ndarray]) -> np.ndarray:
        """Gradient of the pooled states -> gradient of the inputs; the parameters' gradients are added to ``grad``."""
        gw, gu, gb, ga, gc, gv = (grad[n] for n in self.names)
        x, live, hs, both, e, s, g, an, new = (keep[k] for k in ("x", "live", "hs", "both", "e", "s", "g", "an", "new"))
        t, rows, units = x.shape[0], x.shape[1], self.u.shape[1]
        from_pool = np.einsum("ru,tru->tr", d, both)
        ds = s * (from_pool - (s * from_pool).sum(axis=0))
        gv += np.einsum("tr,tra->a", ds, e)
        de = ds[..., None] * self.v * (1 - e * e)
        ga += np.einsum("tru,tra->ua", both, de)
        gc += de.sum(axis=(0, 1))
        d_both = s[..., None] * d + de @ self.a.T
        dh_at = np.stack([d_both[..., :units], d_both[::-1, :, units:]])
        d_gates = np.empty((2, t, rows, 3 * units), np.float32)
        dh = np.zeros((2, rows, units), np.float32)
        for k in range(t - 1, -1, -1):
            dh = dh + dh_at[:, k]
            z, r, h = g[:, k, :, :units], g[:, k, :, units:], hs[:, k]
            step = live[:, k] * dh
            d_new = step * (1 - z) * (1 - new[:, k] ** 2)
            d_z = step * (h - new[:, k]) * z * (1 - z)
            d_r = d_new * an[:, k] * r * (1 - r)
            d_gates[:, k] = np.concatenate([d_z, d_r, d_new], axis=2)
            to_u = np.concatenate([d_z, d_r, d_new * r], axis=2)
            gu += np.matmul(h.transpose(0, 2, 1), to_u)
            dh = dh - step * (1 - z) + np.matmul(to_u, self.u.transpose(0, 2, 1))
        gb += d_gates.sum(axis=(1, 2))
        both_x = np.stack([x, x[::-1]]).reshape(2, t * rows, -1)
        flat = d_gates.reshape(2, t * rows, -1)
        gw += np.matmul(both_x.transpose(0, 2, 1), flat)
        dx = np.matmul(flat, self.w.transpose(0, 2, 1)).reshape(2, t, rows, -1)
        return dx[0] + dx[1, ::-1]


class Vocabulary:
    """Distinct words: their bytes (words, places), lengths and buckets of the embedding table."""

    def __init__(self, words: list[bytes]):
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        wide = max(1, int(self.n.max(initial=1)))
        self.bytes = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide)
        h = np.zeros(len(words), np.uint64)
        for k in range(wide):
            h = np.where(k < self.n, (h + self.bytes[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), h)
        self.bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS


class Net:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def new(cls, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        p = {"chars": rng.normal(0, 0.5, (256, CHAR_DIM)).astype(np.float32), "words": rng.normal(0, 0.1, (BUCKETS, WORD_DIM)).astype(np.float32)}
        p["own"] = np.ones((BUCKETS, 1), np.float32)  # 0 where a bucket's words are too rare for an embedding; not learned
        p |= BiGru.new(rng, "char", CHAR_DIM, CHAR_UNITS) | BiGru.new(rng, "word", WORD_DIM + 2 * CHAR_UNITS, UNITS)
        return cls(p | {"out": rng.normal(0, 0.3, 2 * UNITS).astype(np.float32), "bias": np.zeros(1, np.float32), "said": np.array([1, 0], np.float32)})  # said: slope and offset of the calibration

    def inputs(self, vocabulary: Vocabulary) -> np.ndarray:
        """Input vectors of distinct words, those of like length together."""
        gru, out = BiGru(self.p, "char"), np.empty((len(vocabulary.n), WORD_DIM + 2 * CHAR_UNITS), np.float32)
        out[:, :WORD_DIM] = self.p["words"][vocabulary.bucket] * self.p["own"][vocabulary.bucket]
        order = np.argsort(vocabulary.n, kind="stable")
        for k in range(0, len(order), _AT_ONCE):
            some = order[k : k + _AT_ONCE]
            n = vocabulary.n[some]
            out[some, WORD_DIM:] = gru.forward(self.p["chars"][vocabulary.bytes[some, : n.max()].T], n)
        return out

    def window_logits(self, vectors: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """``windows`` (rows, WINDOW) of places in ``vectors``, -1 behind the end."""
        gru, out = BiGru(self.p, "word"), np.empty(len(windows), np.float32)
        for k in range(0, len(windows), _AT_ONCE):
            some = windows[k : k + _AT_ONCE]
            out[k : k + _AT_ONCE] = gru.forward(vectors[some.T], (some >= 0).sum(axis=1)) @ self.p["out"] + self.p["bias"][0]
        return out

    def scores(self, words: list[bytes], codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probability of each document; ``codes`` are its words in ``words``, up to ``ends``."""
        windows, first = all_windows(codes, ends)
        vectors = np.vstack([self.inputs(Vocabulary(words)), np.zeros((1, WORD_DIM + 2 * CHAR_UNITS), np.float32)])  # a row for places behind the end
        logits = self.window_logits(vectors, windows)
        top = np.maximum.reduceat(logits, first) if len(first) else logits
        slope, offset = self.p["said"].astype(float)
        return 1 / (1 + np.exp(-np.clip(slope * top + offset, -60, 60)))


def all_windows(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the documents and the place of each one's first; the last window of a document may be shorter, one without words has an empty one."""
    size = np.diff(ends, prepend=0)
    count = 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE))
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(doc)) - first[doc]) * STRIDE
    at = start[:, None] + np.arange(WINDOW)
    inside = at < size[doc][:, None]
    padded = np.append(codes, -1)
    return padded[np.where(inside, at + (ends - size)[doc][:, None], len(codes))], first


def read_words(texts: pa.Array, at_once: int = PIECE) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(distinct words, word numbers, ends of the documents) of whole texts in lower case, about ``at_once`` bytes at a time."""
    data, off = text_buffers(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + at_once, "right")) - 1))
        low, ends = _LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        word = _IS_WORD[low]
        head, tail = word.copy(), word.copy()
        head[1:] &= ~word[:-1]
        tail[:-1] &= ~word[1:]
        cut = ends[(ends > 0) & (ends < len(low))]
        head[cut], tail[cut - 1] = word[cut], word[cut - 1]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        parts = -(-(end - start) // WORD_BYTES)
        which = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = start[which] + nth * WORD_BYTES
        end = np.minimum(start + WORD_BYTES, end[which])
        both = np.empty(2 * len(start), np.int64)
        both[0::2], both[1::2] = start, end
        pieces = pa.Array.from_buffers(pa.large_binary(), max(0, len(both) - 1), [None, pa.py_buffer(both), pa.py_buffer(low)])
        found = pieces.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
        yield found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64), np.searchsorted(start, ends[1:])
        i = j


def fit(texts: list[str], labels: list[int], odds: float | None = None, seed: int = 13) -> Net:
    """Fit by Adam; the odds of label 1 (default: those of ``labels``) are put back by the calibration.

    Every ASIDE-th document of a class is kept for the calibration. Without both
    classes the net only states the share of label 1 (0.5 when there is no label).
    """
    net, y = Net.new(seed), np.array(labels, np.float32)
    of_class = [np.flatnonzero(y == c) for c in (0, 1)]
    if not len(of_class[0]) or not len(of_class[1]):
        net.p["out"][:] = 0
        net.p["bias"][:] = 3.0 * (y.mean() * 2 - 1) if len(y) else 0.0
        return net
    sample = _Sample(texts, y)
    aside = np.zeros(len(y), bool)
    for g in of_class:
        aside[g[ASIDE - 1 :: ASIDE]] = True
    net = _train(sample, ~aside, seed)
    share = np.ones(int(aside.sum()))
    if odds is not None:  # each class weighs what it does among all labels
        share = np.where(y[aside] == 1, odds / (y == 1).mean(), 1 / (y == 0).mean()) / (1 + odds)
    net.p["said"][:] = calibration(sample.top_logits(net, aside), y[aside], share)
    return net


class _Sample:
    """The training texts as windows over one vocabulary."""

    def __init__(self, texts: list[str], y: np.ndarray):
        (words, self.codes, ends), *_ = read_words(pa.array(texts, pa.large_string()), 1 << 62)
        self.y, self.vocabulary = y, Vocabulary(words)
        self.windows, self.first = all_windows(self.codes, ends)
        self.last = np.append(self.first[1:], len(self.windows))
        self.doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))

    def top_logits(self, net: Net, docs: np.ndarray) -> np.ndarray:
        return np.array([_logits(net, self.vocabulary, self.windows[self.first[d] : self.last[d]]).max() for d in np.flatnonzero(docs)], float)


def _train(sample: _Sample, docs: np.ndarray, seed: int) -> Net:
    """A network fitted on some documents of the sample, TOXIC of BATCH with label 1 in each step."""
    net, rng = Net.new(seed), np.random.default_rng(seed)
    y, vocabulary, windows = sample.y, sample.vocabulary, sample.windows
    groups = [np.flatnonzero(docs & (y == c)) for c in (0, 1)]
    seen = docs[sample.doc]
    held = np.unique(vocabulary.bucket[sample.codes[seen]] * len(y) + sample.doc[seen]) // len(y)  # each bucket once a document
    net.p["own"][:, 0] = np.bincount(held, minlength=BUCKETS) >= max(3, min(OWN_EMBEDDING, len(groups[1]) // 10))
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(g, n) for g, n in zip(groups, (BATCH - TOXIC, TOXIC)) if len(g)])
        # the window that scores highest; while the network knows nothing, one by chance
        rows = np.concatenate([np.arange(sample.first[d], sample.last[d]) for d in pick])
        known = min(1.0, 4 * step / STEPS)
        logits = _logits(net, vocabulary, windows[rows]) * known + rng.gumbel(size=len(rows)) * (1 - known)
        at = np.cumsum([0, *(sample.last[d] - sample.first[d] for d in pick)])
        best = [rows[a + int(logits[a:b].argmax())] for a, b in zip(at[:-1], at[1:])]
        grad = gradient(net, vocabulary, windows[best], y[pick], rng, TRUST if 3 * step > STEPS else 0.0)
        rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grad.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            net.p[k] -= (rate * (mean[k] / (np.sqrt(square[k]) + 1e-8) + (DECAY / RATE * net.p[k] if k != "bias" else 0))).astype(np.float32)
    return net


def calibration(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic curve through the scores ``x``, by Newton steps; the slope is held near 1 by as much as two rows would."""
    a, rows = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))], axis=1)

    def loss(a):
        z = rows @ a
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (a[0] - 1) ** 2 + 0.05 * a[1] ** 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ a, -60, 60)))
        slope = rows.T @ (weight * (p - y)) + np.array([2 * (a[0] - 1), 0.1 * a[1]])
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag([2.0, 0.1])
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
    return np.array([max(a[0], 0.0), a[1]])


class _Sample:
    """The training texts as windows over one vocabulary."""

    def __init__(self, texts: list[str], y: np.ndarray):
        (words, self.codes, ends), *_ = read_words(pa.array(texts, pa.large_string()), 1 << 62)
        self.y, self.vocabulary = y, Vocabulary(words)
        self.windows, self.first = all_windows(self.codes, ends)
        self.last = np.append(self.first[1:], len(self.windows))
        self.doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))

    def top_logits(self, net: Net, docs: np.ndarray) -> np.ndarray:
        return np.array([_logits(net, self.vocabulary, self.windows[self.first[d] : self.last[d]]).max() for d in np.flatnonzero(docs)], float)


def _train(sample: _Sample, docs: np.ndarray, seed: int) -> Net:
    """A network fitted on some documents of the sample, TOXIC of BATCH with label 1 in each step."""
    net, rng = Net.new(seed), np.random.default_rng(seed)
    y, vocabulary, windows = sample.y, sample.vocabulary, sample.windows
    groups = [np.flatnonzero(docs & (y == c)) for c in (0, 1)]
    seen = docs[sample.doc]
    held = np.unique(vocabulary.bucket[sample.codes[seen]] * len(y) + sample.doc[seen]) // len(y)  # each bucket once a document
    net.p["own"][:, 0] = np.bincount(held, minlength=BUCKETS) >= max(3, min(OWN_EMBEDDING, len(groups[1]) // 10))
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(g, n) for g, n in zip(groups, (BATCH - TOXIC, TOXIC)) if len(g)])
        # the window that scores highest; while the network knows nothing, one by chance
        rows = np.concatenate([np.arange(sample.first[d], sample.last[d]) for d in pick])
        known = min(1.0, 4 * step / STEPS)
        logits = _logits(net, vocabulary, windows[rows]) * known + rng.gumbel(size=len(rows)) * (1 - known)
        at = np.cumsum([0, *(sample.last[d] - sample.first[d] for d in pick)])
        best = [rows[a + int(logits[a:b].argmax())] for a, b in zip(at[:-1], at[1:])]
        grad = gradient(net, vocabulary, windows[best], y[pick], rng, TRUST if 3 * step > STEPS else 0.0)
        rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grad.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            net.p[k] -= (rate * (mean[k] / (np.sqrt(square[k]) + 1e-8) + (DECAY / RATE * net.p[k] if k != "bias" else 0))).astype(np.float32)
    return net


def _seen(vocabulary: Vocabulary, windows: np.ndarray) -> tuple[np.ndarray, Vocabulary, np.ndarray]:
    """The distinct words of some windows, as a vocabulary of their own, and the windows in it."""
    words, code = np.unique(windows, return_inverse=True)
    code = code.reshape(windows.shape)
    if words[0] < 0:
        words, code = words[1:], code - 1
    own = object.__new__(Vocabulary)
    own.n, own.bucket = vocabulary.n[words], vocabulary.bucket[words]
    own.bytes = vocabulary.bytes[words]
    return words, own, code


def _logits(net: Net, vocabulary: Vocabulary, windows: np.ndarray) -> np.ndarray:
    _, own, code = _seen(vocabulary, windows)
    return net.window_logits(np.vstack([net.inputs(own), np.zeros((1, WORD_DIM + 2 * CHAR_UNITS), np.float32)]), code)


def gradient(net: Net, vocabulary: Vocabulary, windows: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None, trust: float = 0.0) -> dict[str, np.ndarray]:
    """Gradient of the mean logistic loss of some windows; with ``rng`` some embeddings are hidden, with ``trust`` doubtful labels weigh less."""
    grad = {k: np.zeros_like(v) for k, v in net.p.items() if k != "own"}
    _, own, code = _seen(vocabulary, windows)
    chars, words, kept_chars, kept_words = BiGru(net.p, "char"), BiGru(net.p, "word"), {}, {}
    shown = np.ones((len(own.n), 1), np.float32) if rng is None else (rng.random((len(own.n), 1)) >= HIDDEN).astype(np.float32)
    if len(own.n):
        seen = own.bytes[:, : own.n.max()].T
        vectors = np.hstack([net.p["words"][own.bucket] * net.p["own"][own.bucket] * shown, chars.forward(net.p["chars"][seen], own.n, kept_chars)])
    else:
        vectors = np.zeros((0, WORD_DIM + 2 * CHAR_UNITS), np.float32)
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    pooled = words.forward(padded[code.T], (code >= 0).sum(axis=1), kept_words)
    logit = pooled @ net.p["out"] + net.p["bias"][0]
    p = 1 / (1 + np.exp(-logit))
    delta = ((p - y) / len(y) * np.where(y > 0.5, p, 1 - p) ** trust).astype(np.float32)
    grad["bias"] += delta.sum()
    grad["out"] += delta @ pooled
    dx = words.backward(delta[:, None] * net.p["out"], kept_words, grad)
    d_vectors = np.zeros_like(padded)
    np.add.at(d_vectors, code.T, dx)
    d_vectors = d_vectors[:-1]
    if len(own.n):
        np.add.at(grad["words"], own.bucket, d_vectors[:, :WORD_DIM] * net.p["own"][own.bucket] * shown)
        np.add.at(grad["chars"], seen, chars.backward(d_vectors[:, WORD_DIM:], kept_chars, grad))
    return grad


def _held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net:
    """Fit on labelled documents that aren't held out: of each class at most SAMPLE, those with the smallest id hashes and a text of up to SAMPLE_BYTES.

    An id is one text, however often its row is repeated: the smallest of its
    texts. The fit is one task, whose rows are bounded by the sample; the
    network's parameters alone reach the driver.
    """
    known = _known(labels, id_col, label_col)
    of_class = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    odds = of_class[1] / of_class[0] if len(of_class) == 2 else None

    def fitted(batches):
        rows = sorted((label, str(key), text) for batch in batches for label, key, text in zip(*(batch.column(k).to_pylist() for k in (1, 0, 2))))
        net = fit([r[2] for r in rows], [r[0] for r in rows], odds)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], names=["net"])

    rows = training_rows(docs, labels, id_col, text_col, label_col).repartition(1).mapInArrow(fitted, "net binary").collect()
    return Net(pickle.loads(bytes(rows[0]["net"]))) if rows else fit([], [])


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    return known.filter(~_held_out("id")).distinct()


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The sample as (id, label, text)."""
    known = _known(labels, id_col, label_col)
    # twice as many ids as the sample has, since long texts fall away
    ids = [known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE) for c in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    one = texts.join(F.broadcast(ids[0].unionAll(ids[1])), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = [one.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for c in (0, 1)]

    return sample[0].unionAll(sample[1]).select("id", "label", "text")


def classify(docs: DataFrame, net: Net, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    One row per input row: id, held_out, score, predicted (1 when score >=
    threshold), n_windows. A null text scores as an empty one, an empty text by
    the bias alone. Repeated rows give repeated results; a null id is not held
    out; other columns are not read. No shuffle; the network is broadcast
    (bounded by its tables).
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            scores, sizes = [], []
            for words, codes, ends in read_words(batch.column(1)):
                scores.append(model.scores(words, codes, ends))
                sizes.append(1 + np.maximum(0, -(-(np.diff(ends, prepend=0) - WINDOW) // STRIDE)))
            cols = [batch.column(0), *(pa.array(np.concatenate(c) if c else [], t) for c, t in ((scores, pa.float64()), (sizes, pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    scored = docs.select(id_col, text_col).mapInArrow(run, schema)
    return scored.select(id_col, _held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labels that aren't held out, then ``classify`` every document."""
    return classify(docs, train(docs, labels, id_col, text_col), threshold, id_col, text_col)
