"""Byte network: gradients, whole-text coverage, held-out accuracy, edge rows."""

import numpy as np
import pytest
from conftest import SF_ORACLE

from alertspark.llm import byte_cnn
from alertspark.llm.byte_cnn import BLOCK, WIDTH, Net, _accumulate, _new_net, classify, fit, score_quality


@pytest.fixture(scope="module")
def net() -> Net:
    n = _new_net(np.random.default_rng(3))
    n.bias[:] = 0.1
    n.fold()
    return n


def _loss(n, data, y):
    n.fold()
    p = n.score(data)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def test_gradient_by_differences(net):
    data = np.random.default_rng(1).integers(32, 127, 1300).astype(np.uint8)
    net.fold()
    names = ("embed", "filters", "bias", "out")
    grad = {k: np.zeros_like(getattr(net, k)) for k in names}
    _accumulate(net, data, 1.0, grad)
    for name in names:
        a = getattr(net, name)
        at = np.unravel_index(np.abs(grad[name]).argmax(), a.shape)
        was = a[at]
        a[at] = was + 1e-3
        up = _loss(net, data, 1.0)
        a[at] = was - 1e-3
        down = _loss(net, data, 1.0)
        a[at] = was
        net.fold()
        assert abs((up - down) / 2e-3 - grad[name][at]) < 0.05 * abs(grad[name][at]) + 1e-3


def test_features_cover_every_byte(net):
    rng = np.random.default_rng(2)
    for n in (1, 5, BLOCK, BLOCK + 1, 3 * BLOCK + 7, 40 * BLOCK + 3):
        data = rng.integers(0, 256, n).astype(np.uint8)
        padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
        y = np.array([[sum(net.tables[k][padded[i + k], f] for k in range(WIDTH)) for f in (0, 7)] for i in range(n)])
        assert np.allclose([y[i : i + BLOCK].max(axis=0) for i in range(0, n, BLOCK)], net.block_maxima(data)[:, [0, 7]], atol=1e-4)


def test_one_class_or_no_labels():
    assert fit([], []).score(np.zeros(0, np.uint8)) == 0.5
    assert fit([b"a", b"b"], [1, 1]).score(np.frombuffer(b"x", np.uint8)) > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    auc = np.mean([(g["score"] > b["score"]) + 0.5 * (g["score"] == b["score"]) for g in good for b in bad])
    assert auc > 0.9 and np.mean([r["predicted"] for r in good]) > 0.95, (auc, len(good), len(bad))


def test_a_repeated_id_is_one_training_text(spark, monkeypatch):
    texts = [(i, f"text {i} " * 20) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(byte_cnn, "fit", lambda raws, ys, odds=None: seen.append((raws, ys, odds)))
    byte_cnn.train(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    again = [(i, t) for i, t in texts for _ in range(300)] + [(1, "zzz")]
    byte_cnn.train(spark.createDataFrame(again, "doc_id long, text string").repartition(7), labels)
    assert seen[0] == seen[1] and 0 < len(seen[0][0]) <= 20


def test_edge_rows(spark, net):
    rows = [(1, None, 9.0), (2, "", 1.0), (3, "x" * 300_000, 1.0), (3, "x" * 300_000, 1.0), (None, "é", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted(classify(df.drop("score"), net).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [1, 2, 3, 3, None] and got[0]["score"] == got[1]["score"] and got[2] == got[3]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got) and got[-1]["held_out"] is False
    kept = classify(df, net, keep_columns=True)
    assert kept.columns[:3] == df.columns and kept.count() == 5 and classify(df.limit(0), net).count() == 0
