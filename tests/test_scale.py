"""Steps that must not repeat work, or hold more at once, as tables grow."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from alertspark.functions import udfs
from alertspark.operators import features as feats
from alertspark.operators import kilonova as kn
from alertspark.operators import learn, rise, sso_spin
from alertspark.operators import lightcurve as lcv
from alertspark.operators import skymatch as sky
from alertspark.plans import modules as mods
from alertspark.plans.queries import ztf_lightcurves
from alertspark.sources import alerts as src
from alertspark.sources import fixtures as fx
from conftest import SF_SMALL


def test_apparent_magnitudes_per_measurement_equal_those_of_the_arrays(spark):
    got = lcv.lightcurve(fx.apparent_alerts(spark, SF_SMALL, 6), ["jd", "dcmag", "dcmag_err"]).select("candid", "cjd", "cdcmag", "cdcmag_err")
    want = feats.dc_mag_arrays(ztf_lightcurves(spark, SF_SMALL), digits=6).select("candid", "cjd", "cdcmag", "cdcmag_err")
    assert got.count() == 1000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_only_the_features_asked_for_are_computed(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [17.0, 17.5], [0.1, 0.1], [1, 1], [0.0, 0.1])], "candid long, cjd array<double>, cmagpsf array<double>, csigmapsf array<double>, cfid array<int>, cdistnr array<double>")
    plan = lambda names: feats.lc_features_long(df, ["candid"], names)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" not in plan(["n", "amplitude"]) and "sort_array" in plan(["median"])


def test_templates_are_fitted_in_batches(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [18.0, 17.0], [0.1], [1, 1])], "candid long, cjd array<double>, cmagpsf array<double>, csigmapsf array<double>, cfid array<int>")
    out = kn.add_kilonova_features(df)
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()  # a shorter array ends in NULLs
    assert r.kt1.flux_peak == pytest.approx(10 ** (0.4 * 8)) and r.kt1.snr_mean is None and r.kt1.snr_max is not None and r.kt2 is None


def test_points_without_a_time_are_on_no_template(spark):
    rows = [(1, [1.0, None, 2.0], [18.0, 17.0, 18.5], [0.1] * 3, [1, 1, 1]), (2, [None, 3.0], [18.0, 17.0], [0.1] * 2, [1, 2]), (3, [None], [18.0], [0.1], [None])]
    df = spark.createDataFrame(rows, "candid long, cjd array<double>, cmagpsf array<double>, csigmapsf array<double>, cfid array<int>")
    got = {r.candid: r for r in kn.add_kilonova_features(df).collect()}
    assert got[1].kt1.flux_peak == pytest.approx(10 ** (0.4 * 8)) and got[1].kt1.tpl0_coef > 0
    assert got[2].kt1.tpl0_coef is None and got[2].kt1.tpl0_shift == 0 and got[2].kt_colour.n_colour == 0 and got[3].kt1 is None


def test_catalogue_cells_are_made_once(spark, tmp_path):
    spark.createDataFrame([(i, 0.01 * i, 0.0, "x") for i in range(50)], "source_id long, ra double, dec double, label string").write.parquet(f"{tmp_path}/cat")
    alerts = spark.createDataFrame([(1, 0.1, 0.0), (2, 5.0, 0.0), (None, None, None)], "candid long, ra double, dec double")
    out = sky.cone_match(alerts, spark.read.parquet(f"{tmp_path}/cat"), 1.0, ["label"], "m", strategy="broadcast")
    assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.candid: r.m_source_id for r in out.collect()} == {1: 10, 2: None, None: None}


def test_small_groups_are_one_call_and_large_ones_are_dealt(spark):
    rows = [("a", i, 1.0) for i in range(12)] + [(None, i, 2.0) for i in range(5)] + [("busy", i, 0.5) for i in range(400)]

    def fn(pdf):
        out = pdf.iloc[:1][["k"]].copy()
        out["s"], out["calls"], out["most"] = float(pdf["x"].sum()), 1, len(pdf)
        return out

    got = udfs.grouped_apply(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], fn, "s double, calls long, most long", {"s": "sum", "calls": "sum", "most": "max"}, "i", part_rows=50)
    got = {r.k: r for r in got.collect()}
    assert {k: r.s for k, r in got.items()} == {"a": 12.0, None: 10.0, "busy": 200.0}
    assert got["a"].calls == got[None].calls == 1 and got["busy"].calls == 8 and got["busy"].most < 100


def test_archive_files_hold_one_night_and_bounded_rows(spark, tmp_path):
    rows = [(i, [float(i)] * 3, 2024, 1, 1) for i in range(300)] + [(i, None, 2024, 1, 2) for i in range(5)] + [(9, [1.0], None, None, None)] * 2
    df = spark.createDataFrame(rows, "candid long, h array<double>, year int, month int, day int")
    src.write_archive(df, f"{tmp_path}/a", file_rows=50)
    sizes = sorted(pq.read_metadata(p).num_rows for p in (tmp_path / "a").rglob("*.parquet"))
    assert sum(sizes) == 307 and sizes[-1] < 100 and len(sizes) == 8
    back = spark.read.schema(df.schema).parquet(f"{tmp_path}/a")
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


def test_modules_get_their_input_columns_only(spark):
    df = ztf_lightcurves(spark, SF_SMALL).withColumn("label", F.lit(1.0))
    assert set(mods.module_inputs(df, ["Asteroid"]).columns) == {"objectId", "candid", "candidate", "label", "cjd", "cmagpsf"}
    every = mods.module_inputs(df).columns
    assert "prv_candidates" not in every and {"cdiffmaglim", "cisdiffpos", "cdistnr"} <= set(every)


_CURVE = "candid long, cjd array<double>, cmagpsf array<double>, csigmapsf array<double>, cfid array<int>"


def _in_batches(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "ArrowEvalPython" in plan and "lambda" not in plan


def test_curve_features_are_made_in_batches(spark):
    rows = [(1, [1.0, 2.0, 4.0], [18.0, 17.0, 17.5], [0.1, 0.2], [1, 1, 1]), (2, [1.0], [None], [0.1], [1]), (3, None, [18.0], [0.1], [1]), (4, [1.0, 2.0], [18.0, 18.5], [0.1, 0.1], [2, 1])]
    out = learn.add_curve_features(spark.createDataFrame(rows, _CURVE), [1, 2], "cf", "cjd", "cmagpsf", "csigmapsf", "cfid", "lower")
    assert _in_batches(out)
    got = {r.candid: r.cf1 for r in out.collect()}
    assert got[1][:4] == (3, 17.0, 17.5, 17.5) and got[1].rise_frac == 0.5 and got[1].span == 3.0 and got[1].err_mean is None  # the shorter array ends in NULL
    assert got[2][:] == (0, *[None] * 7) and got[3][:] == (None,) * 8 and got[4].n == 1 and got[4].slope is None and got[4].span == 0.0


def test_rises_are_fitted_from_points_made_in_batches(spark):
    up = [20.0, 19.0, 18.0, 17.5, 17.2]
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], up, [0.1] * 5, [1] * 5), (2, [1.0, None, 3.0, 4.0, 5.0], up, [0.1] * 5, [1] * 5), (3, None, up, [0.1] * 5, [1] * 5), (4, [1.0, 2.0, 3.0, 4.0, 5.0], up, [0.1, None, 0.0, 0.1, 0.1], [1] * 5)]
    out = rise.add_rise_fits(spark.createDataFrame(rows, _CURVE))
    assert _in_batches(out)
    got = {r.candid: r.rise1 for r in out.collect()}
    assert got[1].status == "ok" and got[1].n_rise == 5 and got[1].chi2 >= 0 and got[4].n_rise == 3
    assert got[2][:] == ("too_few", 5, None, None, None, None) and got[3][:] == ("too_few", 0, None, None, None, None)


def test_trend_and_shape_features_are_made_in_batches(spark):
    rows = [(1, [1.0, 2.0, 3.5, 5.0], [18.0, 17.5, 17.0, 17.4], [0.1, 0.1, 0.2, 0.1], [1] * 4, [0.1] * 4), (2, [1.0, None, 3.0], [18.0, 17.5, 17.0], [0.1, 0.0, 0.2], [1] * 3, [0.1] * 3),
            (3, [1.0, 2.0], [18.0, 17.5], [0.1, 0.1], [1, 1], None)]
    df = spark.createDataFrame(rows, _CURVE + ", cdistnr array<double>")
    out = feats.lc_features_long(df, ["candid"], feats.FEATURES_TREND + feats.FEATURES_SHAPE, bands=(1,))
    assert _in_batches(out)
    got = {r.candid: r for r in out.collect()}
    m, t = np.array(rows[0][2]), np.array(rows[0][1]) - 1.0
    assert got[1].linear_trend == pytest.approx(np.polyfit(t, m, 1)[0]) and got[1].max_slope == pytest.approx(0.5) and got[1].stetson_K is not None
    z = (m - m.mean()) / m.std(ddof=1)
    assert got[1].skew == pytest.approx(4 / 6 * (z**3).sum())
    assert got[2].linear_trend is None and got[2].eta is not None and got[2].stetson_K is None and got[2].max_slope is None
    assert got[3].eta is None and got[3].skew is None
    both = feats.lc_features_long(df, ["candid"], ["skew", "median", "n", "eta"], bands=(1,)).orderBy("candid").collect()
    assert [(r.skew, r.eta) for r in both] == [(got[k].skew, got[k].eta) for k in (1, 2, 3)] and both[0].median == pytest.approx(17.45) and [r.n for r in both] == [4, 3, None]


def _observed(objects, each):
    rng = np.random.default_rng(4)
    rows = [(f"o{k}", int(rng.integers(1, 3)), float(rng.uniform(1, 25)), float(rng.normal(15, 0.2)), 0.02, float(rng.uniform(0, 360)), float(rng.uniform(-60, 60))) for k in range(objects) for _ in range(each)]
    return rows, "ssnamenr string, fid int, phase_deg double, mred double, sigmapsf double, ra double, dec double"


def test_small_objects_shuffle_observations_only(spark, monkeypatch):
    df = spark.createDataFrame(*_observed(3, 40))

    def never(*_):
        raise AssertionError("sums of a small object are shuffled")

    monkeypatch.setattr(sso_spin, "_partial_sums", never)
    assert sso_spin.grid_chi2(df).count() == 3 * len(sso_spin.coarse_grid())
    assert sso_spin.joint_model(df).where("bands is not null").count() == 3


def test_objects_searched_whole_equal_those_searched_in_parts(spark, monkeypatch):
    df = spark.createDataFrame(*_observed(2, 60))
    one = {r.ssnamenr: r for r in sso_spin.joint_model(df).collect()}
    monkeypatch.setattr(sso_spin, "PART_ROWS", 13)
    many = {r.ssnamenr: r for r in sso_spin.joint_model(df).collect()}
    assert one.keys() == many.keys() == {"o0", "o1"}
    for k, a in one.items():
        b = many[k]
        assert (a.n_obs, a.status, [x.fid for x in a.bands], [x.n_obs for x in a.bands]) == (b.n_obs, b.status, [x.fid for x in b.bands], [x.n_obs for x in b.bands])
        assert (a.ra0, a.dec0, a.R, a.chi2, a.misfit) == pytest.approx((b.ra0, b.dec0, b.R, b.chi2, b.misfit), rel=1e-6)
        assert [x.H for x in a.bands] == pytest.approx([x.H for x in b.bands], rel=1e-6)


def test_modules_that_read_apparent_magnitudes_are_evaluated_together(spark):
    rows = [(i, f"o{i % 9}", [1.0 + k + 0.1 * (i % 7) for k in range(8)], [18.0 + 0.1 * k * (i % 3) for k in range(8)], [0.1] * 8, [1, 2] * 4 if i % 4 else [1] * 8, [17.0] * 8, [0.03] * 8, ["t", "f"] * 4, [0.1] * 8, None if i % 11 == 0 else float(i % 2), (3,)) for i in range(90)]
    df = spark.createDataFrame(rows, _CURVE.replace("candid long,", "candid long, objectId string,") + ", cmagnr array<double>, csigmagnr array<double>, cisdiffpos array<string>, cdistnr array<double>, label double, candidate struct<ndethist: int>")
    got = {r.candid: r for r in mods.apply_modules(df, ["Anomaly", "Microlensing"], {"n_trees": 5}).select("candid", "mulens", "anomaly_score").collect()}
    assert len(got) == 90 and {k for k, r in got.items() if r.mulens == 0} == {i for i in range(90) if i % 4 == 0} and all(0 <= r.mulens <= 1 and 0 < r.anomaly_score < 1 for r in got.values())


def test_rows_with_a_history_are_not_sorted_again(spark):
    plan = fx.ztf_alerts(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Sort [") == 1


def test_archive_of_whole_objects_is_written_without_a_shuffle(spark, tmp_path):
    rows = [(i, f"o{i % 7}", [float(i)] * 3, 2024, 1, 1 + i % 2) for i in range(300)] + [(9, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "candid long, objectId string, h array<double>, year int, month int, day int").repartition(3, "objectId")
    held = df.withColumn("p", F.spark_partition_id()).where("year is not null").select("objectId", "p").distinct().collect()
    src.write_archive(df, f"{tmp_path}/a", file_rows=50, key="objectId")
    back = spark.read.schema(df.schema).parquet(f"{tmp_path}/a")
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    files = {p: pq.read_table(p, columns=["objectId"], partitioning=None)["objectId"].to_pylist() for p in (tmp_path / "a").rglob("*.parquet")}
    assert max(map(len, files.values())) <= 50 and all(sorted(x) == x for x in files.values() if None not in x)
    for r in held:  # an object's rows are in the files of the task that had them
        assert {int(p.name[5:10]) for p, x in files.items() if r.objectId in x} == {r.p}


def test_a_large_table_is_timed_in_parts(spark, monkeypatch):
    from alertspark.plans import timing

    seen = []
    apply = timing.apply_modules
    monkeypatch.setattr(timing, "FILE_ROWS", 60)
    monkeypatch.setattr(timing, "apply_modules", lambda df, names, ctx: (seen.append((names[0], df.count())), apply(df, names, ctx))[1])
    runs = timing.time_modules(spark, ztf_lightcurves(spark, SF_SMALL), ["Asteroid", "CDS xmatch (SIMBAD)"], loops=2,
                               ctx={"max_gap_days": 1.0, "catalogs": {"simbad": fx.catalog(spark, SF_SMALL, "simbad")}}, n_cpu=2, part_bytes=200_000).collect()
    assert [(r.module, r.loop, r.total_alerts) for r in runs] == [(m, k, 1000) for m in ("Asteroid", "CDS xmatch (SIMBAD)") for k in (0, 1)] and all(r.t_lapse > 0 for r in runs)
    curves, narrow = ([n for m, n in seen if m == k] for k in ("Asteroid", "CDS xmatch (SIMBAD)"))
    assert sum(curves) == sum(narrow) == 2000 and len(curves) > len(narrow) and max(curves) < 500
