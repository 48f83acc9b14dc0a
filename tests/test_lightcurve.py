"""Light-curve assembly edge cases and the chunked history window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from alertspark.operators import lightcurve as lcv
from alertspark.sources import fixtures as fx
from conftest import SF_SMALL

SCHEMA = ("candid long, candidate struct<jd:double, magpsf:double>, "
          "prv_candidates array<struct<jd:double, magpsf:double>>")


def test_concat_null_and_empty_history(spark):
    rows = [
        (1, (10.0, 18.0), None),
        (2, (11.0, 17.0), []),
        (3, (12.0, None), [(9.0, None), (10.0, 18.5)]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.candid: r for r in lcv.lightcurve(df, ["jd", "magpsf"]).collect()}
    assert out[1].cjd == [10.0] and out[1].cmagpsf == [18.0]
    assert out[2].cjd == [11.0]
    assert out[3].cjd == [9.0, 10.0, 12.0]
    assert out[3].cmagpsf == [None, 18.5, None]  # NULLs kept, arrays aligned


@pytest.mark.parametrize("chunk_days", [3, 1])
def test_chunked_history_equals_plain_window(spark, chunk_days):
    flat = fx.flat_alerts(spark, SF_SMALL)
    day = lcv.DAY_US
    # chunk <= window: every chunk border is crossed by histories (1 day: three halo copies)
    chunked = lcv.build_history(flat, "objectId", "us", {"h": F.struct("jd", "candid")}, window_us=3 * day,
                                chunk_us=chunk_days * day, running_count={"nd": F.col("magpsf")})
    w = Window.partitionBy("objectId").orderBy("us")
    plain = flat.select(
        "candid",
        F.array_sort(F.collect_list(F.struct("jd", "candid")).over(w.rangeBetween(-3 * day, -1))).alias("h"),
        F.count("magpsf").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("int").alias("nd"))
    a = {r.candid: (r.h, r.nd) for r in chunked.select("candid", "h", "nd").collect()}
    b = {r.candid: (r.h, r.nd) for r in plain.collect()}
    assert a == b
    assert len(a) == flat.count()


def test_history_arrays_aligned(spark):
    df = lcv.lightcurve(fx.ztf_alerts(spark, SF_SMALL))
    names = ["c" + f for f in lcv.ZTF_FIELDS]
    sizes = df.select(*[F.size(n).alias(n) for n in names]).collect()
    assert all(len(set(r)) == 1 for r in sizes)


def test_busy_object_is_split_by_time_chunk(spark):
    """One object with most rows: the default chunk spreads it, and the result equals a single huge chunk's."""
    from pyspark.sql import functions as F

    from alertspark.operators import lightcurve as lc

    day = 86_400_000_000
    rows = [("hot", i * day // 4, float(i)) for i in range(800)] + [("cold", 5 * day, 1.0)]
    df = spark.createDataFrame(rows, "objectId string, t long, m double")
    kw = dict(items={"h": F.struct("t", "m")}, running_count={"n": F.col("m")})
    split = lc.build_history(df, "objectId", "t", **kw)
    whole = lc.build_history(df, "objectId", "t", chunk_us=10_000 * day, **kw)
    key = lambda d: sorted((r.objectId, r.t, len(r.h), r.n) for r in d.collect())
    assert key(split) == key(whole)
    assert len({r.t // (30 * day) for r in df.filter("objectId = 'hot'").collect()}) >= 6


@pytest.mark.parametrize("chunk_rows", [10, 50, 5_000])
def test_count_chunks_equal_plain_window(spark, chunk_rows):
    flat = fx.flat_alerts(spark, SF_SMALL)
    day = lcv.DAY_US
    got = lcv.build_history(flat, "objectId", "us", {"h": F.struct("jd", "candid")}, window_us=9 * day, chunk_rows=chunk_rows,
                            running_count={"nd": F.col("magpsf")}, running_min={"first": F.col("jd")})
    w = Window.partitionBy("objectId").orderBy("us")
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    plain = flat.select("candid", F.array_sort(F.collect_list(F.struct("jd", "candid")).over(w.rangeBetween(-9 * day, -1))).alias("h"),
                        F.count("magpsf").over(upto).cast("int").alias("nd"), F.min("jd").over(upto).alias("first"))
    key = lambda d: {r.candid: (r.h, r.nd, r.first) for r in d.select("candid", "h", "nd", "first").collect()}
    assert key(got) == key(plain)


def test_a_third_of_all_rows_in_one_object_and_hour(spark):
    """The busy object's chunks hold about as many rows each, although nearly all its rows lie in one hour; the others aren't copied."""
    hour = lcv.DAY_US // 24
    rows = [("hot", 50 * lcv.DAY_US + i * hour // 3000, i) for i in range(3000)] + [("hot", d * lcv.DAY_US, 9000 + d) for d in range(40)]
    rows += [(f"o{i % 70}", i * lcv.DAY_US // 90, 20_000 + i) for i in range(6000)]
    df = spark.createDataFrame(rows, "objectId string, us long, id long")
    assert lcv.busy_cuts(df, "objectId", "us", 5_000) is None
    cuts = lcv.busy_cuts(df, "objectId", "us", 200)
    dealt = lcv._count_chunks(df, "objectId", "us", hour // 100, cuts)
    sizes = {(r.objectId, r._chunk0): (r.n, r.copies) for r in dealt.groupBy("objectId", "_chunk0").agg(F.count("*").alias("n"), F.sum(F.col("_last") - F.col("_chunk0")).alias("copies")).collect()}
    hot = [n for (o, _), (n, _) in sizes.items() if o == "hot"]
    assert len(hot) >= 15 and max(hot) <= 2 * sorted(hot)[len(hot) // 2] and max(hot) <= 300
    assert all(copies == 0 and chunk == 0 for (o, chunk), (_, copies) in sizes.items() if o != "hot")
    got = lcv.build_history(df, "objectId", "us", {"h": F.col("id")}, window_us=hour // 100, chunk_rows=200, following={"next": F.col("id")}, tie="id")
    rows_of = got.select("objectId", "id", F.size("h").alias("n"), "next").collect()
    assert len(rows_of) == len(rows)
    at = {i: (o, t) for o, t, i in rows}
    times = sorted(t for o, t, _ in rows if o == "hot")
    import bisect

    for r in rows_of:
        if r.objectId == "hot":
            t = at[r.id][1]
            assert r.n == bisect.bisect_left(times, t) - bisect.bisect_left(times, t - hour // 100)
