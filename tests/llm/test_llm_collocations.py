"""Collocations against brute force: counts, scores, containment, order, edge rows."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from alertspark.llm import collocations as C
from alertspark.llm.collocations import collocations, frequent_phrases


def slow(rows, least, longest=5, top=2000, percent=100):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    longer = {}
    for (lang, w), c in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer.get((lang, w[i : i + k]), 0), c)
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or 100 * longer.get((lang, w), -1) >= percent * a:
            continue
        score, k = min((int(Fraction(1000 * a * n[lang], f[lang, w[:k]] * f[lang, w[k:]])), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    words = ["the", "of", "New", "york", "é", "x-y", "a", "b"]
    out = []
    for i in range(300):
        w = list(rng.choice(words, int(rng.integers(0, 40)), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]))
        for _ in range(int(rng.integers(0, 3))):
            w.insert(int(rng.integers(0, len(w) + 1)), "in the city of lights" if i < 200 else "city\tof  lights, at")
        seps = rng.choice([" ", " ", " ", "  ", ". ", "\n", "\x0b", "!"], len(w))
        out.append((["en", "fr", None][i % 3], "".join(a + s for a, s in zip(w, seps))))
    return out


def test_equals_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = slow(rows, 12)
    assert len(want) > 60 and {len(r[2].split()) for r in want} >= {2, 3, 4}
    assert set(map(tuple, collocations(df, least=12).collect())) == want
    monkeypatch.setattr(C, "FULL", -1.0)  # with the joins behind the bit tables, and two shards
    assert set(map(tuple, collocations(df, least=12, shards=2).collect())) == want


def test_phrases_of_one_hash_are_kept_apart():
    text = b"a b a b c a b d a b"
    span = C.Span(C.WordHasher(~C._GAP), np.frombuffer(text * 2, np.uint8), np.array([len(text), 2 * len(text)]), np.array([0, 1]), np.array([5, 6], np.uint64), named=True)
    last = np.flatnonzero(span.place >= 1)
    for hashes in (span.grow(2, span.hash)[last], np.zeros(len(last), np.uint64)):
        one, count = span.groups(2, last, hashes)
        got = {(int(span.lang[j]), w): c for j, w, c in zip(one, span.spell(2, one).to_pylist(), count.tolist())}
        assert got == {(k, w): c for k in (0, 1) for w, c in {"a b": 4, "b a": 1, "b c": 1, "c a": 1, "b d": 1, "d a": 1}.items()}


def test_both_ways_to_read_a_span_agree():
    texts = ["a b. c", "d", "", "e  f,", "Ab\tC d;e", " x", "y "]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([len(t) for t in texts])
    spans = [C.Span(C.WordHasher(~C._GAP), data, ends, np.arange(7), np.arange(7).astype(np.uint64), named) for named in (False, True)]
    assert (spans[0].own == spans[1].own).all() and (spans[0].hash == spans[1].hash).all() and (spans[0].place == spans[1].place).all()
    assert spans[1].spell(1, np.arange(len(spans[1].own))).to_pylist() == "a b c d e f ab c d e x y".split()


def test_top_longest_and_percent(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    got = set(map(tuple, collocations(df, least=20, longest=3, top=4, percent=60, shards=1).collect()))
    assert got == slow(rows, 20, 3, 4, 60)


def test_long_text_is_cut_between_pieces():
    import pyarrow as pa

    text = "a b c. " * 1000 + "d e " * 500 + "\nf g"
    spans = list(C._spans(pa.array(["x y", text, None, "z"]), 256))
    mine = [(data.tobytes(), ends) for data, ends, docs in spans if 1 in docs.tolist() and len(docs) == 1]
    assert b"".join(d for d, _ in mine).decode() == text and len(mine) > 20 and all(len(d) < 2400 for d, _ in mine)
    assert all(C._BREAK[d[-1]] for d, _ in mine[:-1])


def test_edge_rows(spark):
    rows = [(None, None), ("en", ""), ("en", "one two " * 400), ("en", "one two " * 400), ("de", "w" * 100_000), ("de", ". , \n")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, phrase int, n int")
    assert set(map(tuple, collocations(df).collect())) == slow(rows, 100)
    assert collocations(df.limit(0)).count() == 0
    found, n = frequent_phrases(df, 100)
    assert {r["lang"]: r["n"] for r in n.collect()} == {"en": 1600, "de": 1} and found.filter("k = 1").count() == 2
