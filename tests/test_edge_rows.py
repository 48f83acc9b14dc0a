"""Hand-made edge rows (FIXTURES.md section 7)."""

import pytest
from pyspark.sql import functions as F

from alertspark.operators import features as feats
from alertspark.operators import rates, rules
from alertspark.operators import skymatch as sky

LC = ("candid long, cjd array<double>, cmagpsf array<double>, csigmapsf array<double>, cfid array<int>, "
      "cdistnr array<double>")


def test_equally_far_sources_pick_smallest_id(spark):
    a = spark.createDataFrame([(1, 10.0, 0.0)], "candid long, ra double, dec double")
    c = spark.createDataFrame([(7, 10.0, 0.5 / 3600, "x"), (3, 10.0, -0.5 / 3600, "y")],
                              "source_id long, ra double, dec double, label string")
    for strategy in ("broadcast", "shuffle"):
        r = sky.cone_match(a, c, 1.0, ["label"], "m", unknown="Unknown", strategy=strategy).first()
        assert r.m_source_id == 3 and r.m == "y"
    far = sky.cone_match(a, c.where("source_id = 7").withColumn("dec", F.lit(1.0)), 1.0, ["label"], "m",
                         unknown="Unknown").first()
    assert far.m == "Unknown" and far.m_source_id is None


def test_constant_magnitudes_and_same_time(spark):
    rows = [(1, [1.0, 1.0, 2.0, 3.0], [17.0, 17.0, 17.0, 17.0], [0.1] * 4, [1] * 4, [0.0] * 4)]
    r = feats.lc_features_long(spark.createDataFrame(rows, LC), ["candid"], feats.ALL_FEATURES).where("band = 1").first()
    assert r.n == 4 and r["std"] == 0.0 and r.amplitude == 0.0
    assert r.skew is None and r.kurtosis is None and r.eta is None  # zero variance: undefined, not an error
    assert r.max_slope == 0.0  # the two points at one time are skipped (dt = 0)


def test_rate_from_upper_limit(spark):
    schema = ("candidate struct<magpsf:double, sigmapsf:double, jd:double, jdstarthist:double, fid:int>, "
              "cjd array<double>, cmagpsf array<double>, csigmapsf array<double>, cfid array<int>, "
              "cdiffmaglim array<double>")
    rows = [((18.0, 0.1, 12.0, 10.0, 1), [10.0, 11.0, 12.0], [None, None, 18.0], [None, None, 0.1], [1, 1, 1],
             [20.0, 19.5, 21.0])]
    r = spark.createDataFrame(rows, schema).select(rates.magnitude_rate().alias("r")).first().r
    assert r.from_upper is True
    assert r.rate == pytest.approx((18.0 - 19.5) / 1.0)
    assert r.sigma == pytest.approx(0.1)


def test_asteroid_null_inputs_never_2_or_3(spark):
    schema = ("cjd array<double>, cmagpsf array<double>, candidate struct<ndethist:int, sgscore1:double, "
              "ssdistnr:double, distpsnr1:double>")
    rows = [([1.0, 1.01], [18.0, 18.1], (2, None, None, None)), ([1.0], [18.0], (1, 0.1, None, 5.0)),
            ([1.0], [18.0], (1, 0.1, 2.0, 5.0))]
    out = [r.roid for r in spark.createDataFrame(rows, schema).select(rules.asteroid_flag().alias("roid")).collect()]
    assert out == [0, 1, 3]
