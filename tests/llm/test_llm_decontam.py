"""Decontamination against brute force."""

import hashlib
import random
import re

from alertspark.llm.decontam import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def _brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = _words(t)
        if i is not None and w:
            for s in range(max(len(w) - size, 0) + 1):
                windows.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = _words(t), set(), set()
        for s in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[s : s + n]) in windows and s + n <= len(w):
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def _got(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, row int, item string")
    b = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, words string")
    rows = contamination(d, b).drop("items").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    vocab = ["the", "of", "a", "né", "x1", "Über", "42", "ka", "lo", "mi"]
    text = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 25, 40])] + [(20, "the of"), (20, "a né x1 42"), (None, "the"), (21, None), (22, "?!"), (30, text(12))]
    items.append((31, items[7][1]))
    docs = [(i, text(rnd.randrange(60))) for i in range(40)]
    docs += [(100 + i, f"{text(5)} {t or ''} {text(5)}") for i, (_, t) in enumerate(items)] + [(200, items[7][1].upper()), (201, items[7][1] * 3)]
    items = [i for i in items if i[0] != 0 and i[1] != "the of"]  # leave most documents clean
    assert _got(spark, docs, items) == _brute(docs, items)


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, "..."), (4, item), (4, item), (None, item), (5, "z " * 200_000 + item), (6, "one two three four five six seven eight nine"), (7, item.replace(" ", "-"))]
    assert _got(spark, docs, [(7, item), (8, "short one")]) == _brute(docs, [(7, item), (8, "short one")])
    assert _got(spark, docs, []) == _brute(docs, [])
    assert _got(spark, [], [(7, item)]) == []
