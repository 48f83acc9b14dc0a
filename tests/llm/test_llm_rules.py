"""Weak supervision: statistics against brute force, the model, and held labels."""

import random
import re
from collections import Counter

from conftest import SF_ORACLE

from alertspark.llm.weak_rules import BAD, GOOD, estimate, weak_quality

SCHEMA = "doc_id long, text string, n_words string, w string"


def _stats(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x", "é\U0001f600 ü\xa0y", "l\nl\n \n \nl", "#<b>| $5 & 5%*"]
    texts += ["".join(rnd.choice(["ka", "lo", "mi"]) + rnd.choice([" ", " ", "\n", "\t", ", "]) for _ in range(n)) for n in (5, 20, 60, 200, 3000)]
    texts += ["".join(rnd.choice("abcdefghijklmnop") + rnd.choice("abcdefghijklmnop") + " " for _ in range(n)) for n in (30, 300, 2000)] * 2
    texts.append(" ".join(str(i % 40_000) for i in range(90_000)))
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)] + [(None, "null id", None, None), (3, "a", None, None)], SCHEMA)
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in weak_quality(df).collect()}
    want = set()
    for i, t in [*enumerate(texts), (None, "null id")]:
        s = _stats(t)
        want.add((i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == want
    assert weak_quality(df).count() == len(texts) + 2 and weak_quality(df.limit(0)).count() == 0


def test_accuracies_are_found_from_votes_alone():
    rnd = random.Random(8)
    true_good, on_good, on_bad = 0.85, [0.99, 0.97, 0.9], [0.6, 0.5, 0.7]
    votes = Counter()
    for _ in range(40_000):
        good = rnd.random() < true_good
        votes[tuple(0 if rnd.random() < 0.1 else (GOOD if rnd.random() < on_good[r] else BAD) if good else (BAD if rnd.random() < on_bad[r] else GOOD) for r in range(3))] += 1
    m = estimate(sorted(votes.items()), 3)
    assert abs(m.good - true_good) < 0.03
    assert all(abs(a - b) < 0.05 for a, b in zip(m.on_good + m.on_bad, on_good + on_bad))
    assert 0 < m.posterior((BAD, BAD, BAD)) < 0.01 < 0.95 < m.posterior((GOOD, GOOD, GOOD)) < 1


def test_verdicts_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = weak_quality(docs).filter("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    kept = [r["kept"] for r in rows if r["quality"] == 1]
    gone = [not r["kept"] for r in rows if r["quality"] == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(gone) >= 0.8 * len(gone), (sum(kept), len(kept), sum(gone), len(gone))


def test_plan_has_no_python(spark):
    plan = weak_quality(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
