"""Near duplicates against brute force on planted groups, and edge rows."""

import random

from alertspark.llm.minhash_dedup import near_duplicates, shingle_set

SCHEMA = "doc_id long, text string, bands string, node string"


def _brute(rows, words, percent):
    sets = [shingle_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), c, d == c) for i, ((d, _), s) in enumerate(zip(rows, sets)) for c in [least.get(root(i)) if s else d]), key=_key)


def _key(r):
    return (r[0] is None, r[0] or 0, r[1], str(r[2]))


def _planted(rnd):
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(3))
    texts = []
    for n in (5, 40, 200):
        base = [word() for _ in range(n)]
        texts += [" ".join(base)] * 3
        for k in (1, 2, 3, 5):
            for _ in range(12):  # near copies around the threshold, most of them nearer to the base than to each other
                w = list(base)
                for _ in range(max(1, n * k // 60)):
                    w[rnd.randrange(n)] = word()
                texts.append(" ".join(w))
        chain = list(base)
        for _ in range(10):  # a chain: the ends are far apart
            chain = chain[max(1, n // 25) :] + [word() for _ in range(max(1, n // 25))]
            texts.append(" ".join(chain))
    shared = [word() for _ in range(30)]
    texts += [" ".join(shared + [word() for _ in range(rnd.choice((6, 12, 30, 80)))]) for _ in range(60)]
    return texts


def test_groups_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, t) for i, t in enumerate(_planted(rnd))]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    for words, percent in ((4, 80), (5, 80)):
        got = sorted(map(tuple, near_duplicates(df, words, percent).collect()), key=_key)
        assert got == _brute(rows, words, percent)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b c d e"), (5, "a B c d e"), (5, "a B c d e"), (6, "a b"), (7, "A\x0bB"), (None, "a b"), (None, "solo words only"), (8, "x\xa0y z w v"), (9, "q " * 30000), (10, "q " * 29000)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = sorted(map(tuple, near_duplicates(df, 4, 80).collect()), key=_key)
    want = [r if r[2] is not None else (*r[:3], True) for r in _brute(rows, 4, 80)]
    assert got == sorted(want, key=_key)
    assert near_duplicates(df.limit(0), 4, 80).count() == 0


def test_no_links(spark):
    df = spark.createDataFrame([(i, f"only text number {i} here") for i in range(6)], "doc_id long, text string")
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in near_duplicates(df).collect())
