"""Every registered query with an oracle matches DuckDB on the small fixture."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.compare import compare, duck

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, SF_SMALL, key, E.queries()[key], ORACLES[key], con)
    assert r["cols_ok"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["tol"], r


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert sum(r["n_alerts"] for r in rows) == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
