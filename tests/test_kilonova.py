"""Kilonova features against plain Python; labels from the object's next alert."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertspark.operators import kilonova as kn
from alertspark.operators import learn
from alertspark.operators.lightcurve import DAY_US, build_history

CURVE = "candid long, cjd array<double>, cmagpsf array<double>, csigmapsf array<double>, cfid array<int>"


def slow_templates(t, m, e):
    y = [10 ** (-0.4 * (x - 25)) for x in m]
    z = [x / max(y) for x in y]
    day = [math.floor(x - t[0]) for x in t]
    snr = [1 / (0.4 * math.log(10) * x) for x in e]
    out = {"flux_peak": max(y), "snr_max": max(snr), "snr_mean": sum(snr) / len(snr)}
    for j, tpl in enumerate(kn.templates()):
        at = lambda d: tpl[d] if d < len(tpl) else 0.0
        tries = [(sum(a * at(d + s) for a, d in zip(z, day)), sum(at(d + s) ** 2 for d in day), -s) for s in range(kn.SHIFTS)]
        _, back, dot, norm = max((round(d / math.sqrt(n), 9) if n else 0.0, b, d, n) for d, n, b in tries)
        out |= {f"tpl{j}_coef": dot / norm if norm else None, f"tpl{j}_shift": -back, f"tpl{j}_cos": dot / math.sqrt(norm * sum(a * a for a in z)) if norm else None}
    return out


def slow_colours(points):
    got, last = [], None
    for t, first, m in sorted((t, b == 1, m) for t, m, b in points if m is not None and b < 3):
        if not first:
            last = (t, m)
        elif last and t - last[0] <= kn.COLOUR_DAYS:
            got.append((t, m - last[1]))
    if not got:
        return (0, None, None, None, None)
    span = got[-1][0] - got[0][0]
    return (len(got), sum(c for _, c in got) / len(got), got[0][1], got[-1][1], (got[-1][1] - got[0][1]) / span if span else None)


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        n = int(rng.integers(0, 30))
        t = np.sort(np.round(rng.uniform(0, 6, n), 1 if k % 2 else 3)) + 2460000
        m = [None if rng.random() < 0.2 else float(x) for x in rng.uniform(16, 21, n)]
        rows.append((k, t.tolist(), m, [None if x is None else float(s) for x, s in zip(m, rng.uniform(0.02, 0.3, n))], rng.integers(1, 4, n).tolist()))
    return rows


def test_features_equal_plain_python(spark, curves):
    df = kn.add_kilonova_features(spark.createDataFrame(curves, CURVE))
    got = {r.candid: r for r in df.select("candid", *kn.flat_kilonova_features()).collect()}
    seen = 0
    for k, t, m, e, b in curves:
        assert tuple(got[k][f"kt_{c}"] for c in kn.COLOUR_FEATURES) == pytest.approx(slow_colours(list(zip(t, m, b))), abs=1e-9)
        for band in (1, 2):
            own = [(x, y, z) for x, y, z, f in zip(t, m, e, b) if f == band and y is not None]
            want = slow_templates(*map(list, zip(*own))) if own else dict.fromkeys(kn.FLUX_FEATURES + kn.TEMPLATE_FEATURES)
            seen += len(own)
            for name, value in want.items():
                assert got[k][f"kt{band}_{name}"] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), (k, band, name)
    assert seen > 100


def test_a_curve_that_is_a_template_is_found(spark):
    rows = []
    for j, tpl in enumerate(kn.templates()):
        days = [d for d in range(12) if tpl[d + 3] > 1e-4]
        rows.append((j, [float(d) for d in days], [25 - 2.5 * math.log10(300 * tpl[d + 3]) for d in days], [0.1] * len(days), [1] * len(days)))
    got = kn.add_kilonova_features(spark.createDataFrame(rows, CURVE)).select("candid", *kn.flat_kilonova_features()).collect()
    for r in got:
        cos = [r[f"kt1_tpl{j}_cos"] for j in range(3)]
        assert cos[r.candid] == pytest.approx(1.0, abs=1e-6) and int(np.argmax(cos)) == r.candid
    assert got[2]["kt1_tpl2_shift"] == 3 and got[0]["kt1_tpl0_shift"] == 0


def test_no_arrays_and_missing_errors(spark):
    rows = [(1, None, None, None, None), (2, [], [], [], []), (3, [1.0, 2.0], [18.0, None], [None, None], [1, 1])]
    got = {r.candid: r for r in kn.add_kilonova_features(spark.createDataFrame(rows, CURVE)).select("candid", *kn.flat_kilonova_features()).collect()}
    assert got[1]["kt1_flux_peak"] is None and got[2]["kt_n_colour"] == 0 and got[3]["kt1_snr_max"] is None and got[3]["kt1_tpl0_coef"] == 1.0


def _flat(spark, rows):
    return spark.createDataFrame(rows, "obj string, us long, id long, kind string")


@pytest.mark.parametrize("how", [{"chunk_us": 30 * DAY_US}, {"chunk_us": DAY_US}, {"chunk_rows": 40}, {"chunk_rows": 7}, {}])
def test_following_row_over_chunk_borders(spark, how):
    rng = np.random.default_rng(7)
    rows = [("busy", int(x) * DAY_US // 50, i, None if i % 7 == 0 else f"k{i % 5}") for i, x in enumerate(rng.integers(0, 3000, 600))]
    rows += [("rare", d * DAY_US, 1000 + i, f"r{i}") for i, d in enumerate((0, 29, 30, 31, 200, 200, 900))] + [("one", 5, 2000, "x")]
    got = build_history(_flat(spark, rows), "obj", "us", {"h": F.struct("us", "id")}, 3 * DAY_US, **how, following={"next": F.col("kind"), "next_id": F.col("id")}, tie="id")
    assert got.columns == ["obj", "us", "id", "kind", "h", "next", "next_id"]
    want = {}
    for o in ("busy", "rare", "one"):
        mine = sorted((r for r in rows if r[0] == o), key=lambda r: (r[1], r[2]))
        want |= {a[2]: (b[3], b[2]) if b else (None, None) for a, b in zip(mine, [*mine[1:], None])}
    assert {r["id"]: (r["next"], r["next_id"]) for r in got.collect()} == want


def test_last_alert_is_not_trained_on(spark, monkeypatch):
    df = spark.createDataFrame([(f"o{i}", float(i), None if i % 3 == 0 else float(i % 2)) for i in range(300)], "obj string, x double, label double")
    seen = []
    real = learn.fit
    monkeypatch.setattr(learn, "fit", lambda train, spec: (seen.append(train.filter("label is null").count()), real(train, spec))[1])
    out = learn.fit_and_score(df, learn.MLSpec(feature_cols=["x"], kind="lr"), F.lit(True), F.col("obj"), "p")
    assert out.count() == 300 and seen == [0] and out.filter("p is null").count() == 0
