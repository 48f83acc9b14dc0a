"""Cone join against brute force, including poles and the RA = 0 line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertspark.operators import skymatch as sky


def _points(rng, n):
    ra = rng.uniform(0, 360, n)
    dec = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    # crowd the hard places: both poles, the RA wrap, high declinations
    k = n // 5
    ra[:k] = rng.uniform(359.99, 360.0, k) % 360.0
    dec[k:2 * k] = rng.uniform(89.99, 90.0, k)
    dec[2 * k:3 * k] = rng.uniform(-90.0, -89.99, k)
    dec[3 * k:4 * k] = rng.uniform(85.0, 89.5, k)
    return ra, dec


def _brute(ra1, dec1, ra2, dec2, r_arcsec):
    d1, d2 = np.radians(dec1)[:, None], np.radians(dec2)[None, :]
    a = np.sin((d2 - d1) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin(np.radians(ra2[None, :] - ra1[:, None]) / 2) ** 2
    sep = np.degrees(2 * np.arcsin(np.minimum(1, np.sqrt(a)))) * 3600
    i, j = np.nonzero(sep <= r_arcsec)
    return set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("radius", [1.5, 60.0])
def test_pairs_equal_brute_force(spark, radius):
    rng = np.random.default_rng(7)
    ra1, dec1 = _points(rng, 1500)
    ra2, dec2 = _points(rng, 1500)
    # plant near neighbours so every radius has matches
    ra2[:300] = (ra1[:300] + rng.normal(0, radius / 3600 / 2, 300)) % 360
    dec2[:300] = np.clip(dec1[:300] + rng.normal(0, radius / 3600 / 2, 300), -90, 90)
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(ra1, dec1))], "candid long, ra double, dec double")
    c = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(ra2, dec2))], "source_id long, ra double, dec double")
    pairs = sky.cone_pairs(a, c, radius).select("candid", "source_id").collect()
    got = {(r.candid, r.source_id) for r in pairs}
    assert len(got) == len(pairs)  # no duplicates
    assert got == _brute(ra1, dec1, ra2, dec2, radius)


def test_strategies_agree_and_nearest(spark):
    rng = np.random.default_rng(3)
    ra1, dec1 = _points(rng, 800)
    ra2 = np.concatenate([ra1 % 360, (ra1 + 0.5 / 3600) % 360])
    dec2 = np.concatenate([np.clip(dec1 + 0.2 / 3600, -90, 90), dec1])
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(ra1, dec1))], "candid long, ra double, dec double")
    c = spark.createDataFrame([(i, float(x), float(y), f"L{i}") for i, (x, y) in enumerate(zip(ra2, dec2))],
                              "source_id long, ra double, dec double, label string")
    b = sky.cone_match(a, c, 2.0, ["label"], "m", unknown="Unknown", strategy="broadcast")
    s = sky.cone_match(a, c, 2.0, ["label"], "m", unknown="Unknown", strategy="shuffle")
    rb = {r.candid: (r.m, r.m_source_id) for r in b.collect()}
    rs = {r.candid: (r.m, r.m_source_id) for r in s.collect()}
    assert rb == rs
    assert len(rb) == 800


def test_plan_has_no_nested_loop(spark):
    a = spark.range(100).select(F.col("id").alias("candid"), (F.col("id") * 1.0).alias("ra"), F.lit(1.0).alias("dec"))
    c = spark.range(100).select(F.col("id").alias("source_id"), (F.col("id") * 1.0).alias("ra"), F.lit(1.0).alias("dec"),
                                F.lit("x").alias("label"))
    for strategy in ("broadcast", "shuffle"):
        plan = sky.cone_match(a, c, 1.0, ["label"], "m", strategy=strategy)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, plan


def test_unknown_catalogue_columns():
    assert sky.parse_columns("DR3Name,Plx,e_Plx") == ["DR3Name", "Plx", "e_Plx"]
    with pytest.raises(ValueError):
        sky.parse_columns(" , ")


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_repeated_and_missing_ids_match_by_their_own_position(spark, strategy):
    alerts = spark.createDataFrame([(1, 10.0, 5.0), (1, 50.0, 5.0), (None, 10.0, 5.0), (2, None, 5.0)], "candid long, ra double, dec double")
    cat = spark.createDataFrame([("s", 10.0, 5.0, "x")], "source_id string, ra double, dec double, kind string")
    got = sky.cone_match(alerts, cat, 1.0, ["kind"], "label", unknown="Unknown", strategy=strategy).select("ra", "label").collect()
    assert sorted((r.ra or 0.0, r.label) for r in got) == [(0.0, "Unknown"), (10.0, "x"), (10.0, "x"), (50.0, "Unknown")]


def test_a_dense_cluster_equals_brute_force(spark, monkeypatch):
    """100,000 sources within some arc seconds, and sources around: both strategies, all pairs and the nearest."""
    rng = np.random.default_rng(12)
    n = 100_000
    ra2, dec2 = 120.0 + rng.normal(0, 8 / 3600, n), 35.0 + rng.normal(0, 8 / 3600, n)
    ra1 = np.concatenate([120.0 + rng.normal(0, 9 / 3600, 250), rng.uniform(119.9, 120.1, 150)])
    dec1 = np.concatenate([35.0 + rng.normal(0, 9 / 3600, 250), rng.uniform(34.9, 35.1, 150)])
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(ra1, dec1))], "candid long, ra double, dec double")
    import pandas as pd

    c = spark.createDataFrame(pd.DataFrame({"source_id": np.arange(n), "ra": ra2, "dec": dec2})).withColumn("label", F.concat(F.lit("L"), "source_id")).repartition(4)
    radius = 0.25
    want = _brute(ra1, dec1, ra2, dec2, radius)
    assert len(want) > 3000
    pairs = sky.cone_pairs(a, c, radius).select("candid", "source_id").collect()
    assert len(pairs) == len(want) and {(r.candid, r.source_id) for r in pairs} == want
    near = [{r.candid: (r.m, r.m_source_id) for r in sky.cone_match(a, c, radius, ["label"], "m", unknown="Unknown", strategy=s).collect()} for s in ("broadcast", "shuffle")]
    assert near[0] == near[1] and len(near[0]) == 400
    matched = {i for i, _ in want}
    assert all((near[0][i][1] is not None) == (i in matched) and (i, near[0][i][1]) in want for i in matched)
    grid, fine = sky._Grid(radius), sky._finer(radius, sky.MIN_ZONE_ARCSEC)
    usual, finer, keys = sky._split_dense(c, grid, fine, ["label"], "ra", "dec", "source_id", sky.DENSE)
    largest = lambda d: d.groupBy("_zone", "_bucket").count().agg(F.max("count")).first()[0]
    assert largest(usual) <= sky.DENSE and largest(finer) < 400 and keys.count() > 0
    assert largest(sky._catalog_cells(c, grid, ["label"], "ra", "dec", "source_id")) > 5000


def test_broadcast_is_bound_by_bytes(spark):
    wide = spark.range(100).select(F.col("id").alias("source_id"), F.repeat(F.lit("x"), 1000).alias("label"))
    assert sky.catalog_fits_broadcast(wide, 100, 10 ** 6, ["label"]) and not sky.catalog_fits_broadcast(wide, 100, 10 ** 5, ["label"])
    assert not sky.catalog_fits_broadcast(wide, 99) and sky.catalog_fits_broadcast(wide.limit(0), 5, None, ["label"])
