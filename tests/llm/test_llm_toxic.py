"""Toxicity network: gradients, windows over whole texts, held-out accuracy, edge rows."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL

from alertspark.llm.toxic_gru import STRIDE, WINDOW, Net, Vocabulary, _logits, all_windows, calibration, classify, fit, gradient, read_words, train, training_rows


def test_gradient_by_differences():
    net = Net.new(1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    words = Vocabulary([b"ab", b"abcde", b"z", b"longerword"])
    windows = np.full((3, WINDOW), -1)
    windows[0, :5], windows[1, :2] = [0, 1, 2, 3, 0], [3, 3]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = _logits(net, words, windows).astype(float)
        return np.mean(np.logaddexp(0, z) - y * z)

    for name, g in gradient(net, words, windows, y).items():
        if name in ("said",):
            continue
        a = net.p[name]
        at = np.unravel_index(np.abs(g).argmax(), a.shape)
        was = a[at]
        a[at] = was + 1e-2
        up = loss()
        a[at] = was - 1e-2
        down = loss()
        a[at] = was
        assert abs((up - down) / 2e-2 - g[at]) < 1e-5 + 0.01 * abs(g[at]), name


def test_windows_cover_every_word():
    sizes = [0, 1, WINDOW, WINDOW + 1, 3 * WINDOW + 5, 1000]
    codes, ends = np.arange(sum(sizes)), np.cumsum(sizes)
    windows, first = all_windows(codes, ends)
    for k, (n, e) in enumerate(zip(sizes, ends)):
        mine = windows[first[k] : first[k + 1] if k + 1 < len(first) else None]
        assert sorted(set(mine[mine >= 0].tolist())) == list(range(e - n, e)) and len(mine) == 1 + max(0, -(-(n - WINDOW) // STRIDE))
        assert all(w[0] == e - n + i * STRIDE for i, w in enumerate(mine)) or n == 0


def test_words_of_whole_texts():
    texts = ["Ab, c-D\n", None, "", "x" * 60, "é9 "]
    for at_once in (1, 1 << 20):
        got = []
        for words, codes, ends in read_words(pa.array(texts), at_once):
            got += [[words[c] for c in codes[a:b]] for a, b in zip([0, *ends[:-1]], ends)]
        assert got == [[b"ab", b"c", b"d"], [], [], [b"x" * 24, b"x" * 24, b"x" * 12], ["é9".encode()]]


def test_score_is_the_top_window():
    net = Net.new(2)
    text = " ".join(f"w{i % 37}" for i in range(200))
    (words, codes, ends), = read_words(pa.array([text]))
    vectors = net.inputs(Vocabulary(words))
    one_by_one = [net.window_logits(vectors, w[None])[0] for w in all_windows(codes, ends)[0]]
    assert np.isclose(net.scores(words, codes, ends)[0], 1 / (1 + np.exp(-max(one_by_one))), atol=1e-5)


def test_calibration_recovers_a_curve():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 4, 5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(0.5 * x - 2)))).astype(float)
    assert np.allclose(calibration(x, y, np.ones(5000)), [0.5, -2], atol=0.15)


def test_one_class_or_no_labels():
    empty = (np.zeros(0, np.int64), np.zeros(1, np.int64))
    assert fit([], []).scores([], *empty)[0] == 0.5
    assert fit(["a", "b"], [1, 1]).scores([], *empty)[0] > 0.9


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of made-up words; a third of them holds insults at chance places, one label in 20 is wrong."""
    rng = np.random.default_rng(4)
    common = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(300)]
    rows = []
    for i in range(900):
        words = list(rng.choice(common, int(rng.integers(20, 150))))
        toxic = i % 3 == 0
        for w in rng.choice(["idiot", "scum", "moron"], int(rng.integers(2, 5)) if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), w)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = [(i, y if rng.random() > 0.05 else 1 - y) for i, _, y in rows]
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents(planted):
    docs, labels = planted
    net = train(docs, labels)
    rows = classify(docs, net).join(docs, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    assert len(rows) > 100
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) > 0.95 and np.mean([r["predicted"] for r in rows if not r["toxic"]]) < 0.05


def test_a_repeated_id_is_one_training_text(spark):
    docs = [(i, f"text {i} " * 5) for i in range(20)] + [(30, "long " * 20_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(31)], "doc_id long, toxic int")
    one = training_rows(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()
    again = training_rows(spark.createDataFrame(docs * 30 + [(1, "zzz")], "doc_id long, text string").repartition(7), labels).collect()
    assert sorted(one) == sorted(again) and 0 < len(one) <= 20 and all(len(r["text"]) < 1000 for r in one)


def test_edge_rows(spark):
    net = Net.new(3)
    rows = [(1, None, 9.0), (2, "", 1.0), (3, "x" * 300_000, 1.0), (3, "x" * 300_000, 1.0), (None, "é", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted(classify(df, net).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [1, 2, 3, 3, None] and got[0]["score"] == got[1]["score"] and got[2] == got[3]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got) and got[-1]["held_out"] is False
    assert got[2]["n_windows"] > 700 and classify(df.limit(0), net).count() == 0
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert classify(docs, net).count() == docs.count()
