"""Physical-plan properties: pruning, pushdown, no Python in native operators."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NATIVE = ["asteroid_flag", "history_window", "lc_features_basic", "mag_rate", "dc_mag", "xmatch_simbad",
          "xmatch_local", "stamp_ks", "stamp_sigma_clip", "kn_cuts", "snn_vector", "sso_phase_linear",
          "throughput_targets", "line_cost"]


def _plan(spark, key):
    return E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", NATIVE)
def test_native_queries_stay_in_jvm(spark, key):
    p = _plan(spark, key)
    assert "EvalPython" not in p and "FlatMapGroupsInPandas" not in p, p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_night_scan_prunes_partitions(spark):
    p = _plan(spark, "scan_night")
    line = [x for x in p.split("\n") if "FileScan" in x][0]
    assert "PartitionFilters: [" in line and "(year" in line and "(month" in line and "(day" in line, line


def test_projection_prunes_nested_columns(spark):
    p = _plan(spark, "count_alerts")
    line = [x for x in p.split("\n") if "FileScan" in x][0]
    assert "prv_candidates" not in line, line  # only partition columns are needed


def test_class_read_prunes_partitions(spark):
    p = _plan(spark, "scan_class")
    line = [x for x in p.split("\n") if "FileScan" in x][0]
    assert "PartitionFilters: [" in line and "alertclass" in line.split("PartitionFilters:")[1], line
