"""Periodic runs against brute force: LCE, runs, collapsed texts, digests, edge rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from alertspark.llm import word_runs
from alertspark.llm.queries import op12_periodic_runs
from alertspark.llm.word_runs import CoverLce, periodic_runs, runs, shifts


def slow_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rs = slow_runs(w)
    gone = {i for s, m, q in rs for i in range(s + q, s + m)}
    best = None
    for r in rs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in rs)
    return (doc_id, len(rs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_difference_cover():
    assert shifts().max() < word_runs.MODULUS
    differences = {(a - b) % word_runs.MODULUS for a in word_runs.COVER for b in word_runs.COVER}
    assert differences == set(range(word_runs.MODULUS))


@pytest.mark.parametrize("letters, n", [(1, 90), (2, 150), (2, 400), (40, 300)])
def test_lce(letters, n):
    rng = np.random.default_rng(letters * n)
    w = rng.integers(0, letters, n)
    w[n // 2 : n // 2 + n // 3] = w[: n // 3]
    w = np.append(w, 99)
    lce = CoverLce(w)
    i, j = (a.ravel() for a in np.triu_indices(n + 1, 1))
    pick = rng.choice(len(i), min(len(i), 3000), replace=False)
    i, j = i[pick], j[pick]
    want = [next(k for k in range(n + 2) if b + k > n or w[a + k] != w[b + k]) for a, b in zip(i, j)]
    assert lce(i, j).tolist() == want


def test_runs_of_random_documents(monkeypatch):
    rng = np.random.default_rng(7)
    for pairs in (word_runs.PAIRS, 50):
        monkeypatch.setattr(word_runs, "PAIRS", pairs)
        for _ in range(60):
            docs = []
            for _ in range(rng.integers(1, 8)):
                n, p = int(rng.integers(0, 130)), int(rng.integers(1, 20))
                w = rng.integers(0, rng.integers(1, 5), n)
                if n and rng.random() < 0.5:
                    a, i = int(rng.integers(0, n)), np.arange(n)
                    w = w[np.where(i < a, i, np.minimum(a + (i - a) % p, n - 1))]
                docs.append(w)
            doc, s, m, q = runs(np.concatenate(docs).astype(np.int64), np.array([len(d) for d in docs]))
            for k, w in enumerate(docs):
                assert list(zip(s[doc == k].tolist(), m[doc == k].tolist(), q[doc == k].tolist())) == slow_runs(w.tolist())


def test_long_document():
    w = np.concatenate([np.arange(5000), np.arange(20_000) % 700, [0] * 30_000])
    doc, s, m, q = runs(w, np.array([len(w)]))
    assert (5000, 20_000, 700) in set(zip(s.tolist(), m.tolist(), q.tolist())) and (25_000, 30_000, 1) in set(zip(s.tolist(), m.tolist(), q.tolist()))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    assert sum(r[1] > 0 for r in got.values()) > 10
    for d in docs:
        assert got[d["doc_id"]] == slow_row(d["doc_id"], d["text"])


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a\x0b" * 6, 1), (3, "a\x0b" * 6, 1), (None, " x " * 7, 1), (4, "ä ö " * 4 + "é", 1), (5, "w" * 200_000, 2), (6, "a b c " * 60_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(periodic_runs(df).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in got] == [
        (1, 0, []), (2, 0, []), (3, 6, [(0, 6, 1)]), (3, 6, [(0, 6, 1)]), (4, 9, [(0, 8, 2)]), (5, 1, []), (6, 180_000, [(0, 180_000, 3)]), (None, 7, [(0, 7, 1)]),
    ]
    assert [r["collapsed"] for r in got] == ["", "", "a", "a", "ä ö é", "w" * 200_000, "a b c", "x"]
    assert periodic_runs(df.limit(0)).count() == 0
