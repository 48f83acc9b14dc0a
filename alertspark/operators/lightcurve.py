"""Light-curve assembly (history + current measurement -> aligned arrays).

``concat_col`` adds ``<prefix><name>`` = history values (oldest first) followed
by the current value. A NULL history counts as empty; NULL elements are kept so
all arrays of one alert stay aligned by position.

``build_history`` derives a history array from flat rows (one row per
measurement) with a bounded range window. Busy objects are cut into chunks of
bounded row counts (with a halo of one history window copied from the chunks
before), so one very busy object never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertspark.session import reliable_checkpoint

DAY_US = 86_400_000_000

# Fixed field lists of the two surveys' light curves (order as in the contract).
ZTF_FIELDS = ["jd", "magpsf", "sigmapsf", "fid", "magnr", "sigmagnr", "isdiffpos", "diffmaglim", "distnr"]
RUBIN_FIELDS = ["midPointTai", "psFlux", "psFluxErr", "filterName"]


def _field_type(df: DataFrame, struct_col: str, name: str) -> T.DataType:
    st = df.schema[struct_col].dataType
    return st[name].dataType


def concat_col_expr(
    df: DataFrame,
    colname: str,
    prefix: str = "c",
    current: str = "candidate",
    history: str = "prv_candidates",
) -> Column:
    dtype = _field_type(df, current, colname)
    hist = F.coalesce(F.col(f"{history}.{colname}"), F.array().cast(T.ArrayType(dtype)))
    return F.concat(hist, F.array(F.col(f"{current}.{colname}"))).alias(prefix + colname)


def concat_col(df: DataFrame, colname: str, prefix: str = "c", current: str = "candidate",
               history: str = "prv_candidates") -> DataFrame:
    """Add ``prefix + colname``: history values then the current one."""
    return df.withColumn(prefix + colname, concat_col_expr(df, colname, prefix, current, history))


def lightcurve(df: DataFrame, fields: Iterable[str] = ZTF_FIELDS, prefix: str = "c",
               current: str = "candidate", history: str = "prv_candidates") -> DataFrame:
    """All light-curve arrays in one projection (one Project node)."""
    return df.select("*", *[concat_col_expr(df, f, prefix, current, history) for f in fields])


def lightcurve_rubin(df: DataFrame, prefix: str = "c") -> DataFrame:
    return lightcurve(df, RUBIN_FIELDS, prefix, current="diaSource", history="prvDiaForcedSources")


#: Rows of an object that one window sorts at once; objects with more are cut at quantiles of time.
CHUNK_ROWS = 5_000
#: Cuts of an object at most; busy objects whose cuts are broadcast (at most 8 kB each).
CUTS, BROADCAST_BUSY = 1_000, 200


def _time_chunks(flat: DataFrame, time_us: str, window_us: int, chunk_us: int) -> DataFrame:
    """Adds ``_chunk0``, a row's own chunk of fixed length, ``_last``, the last one whose rows can see it, and ``_cut`` (true)."""
    t = F.col(time_us)
    at = lambda x: F.floor(x / F.lit(chunk_us)).cast("long")
    return flat.select("*", at(t).alias("_chunk0"), at(t + F.lit(window_us)).alias("_last"), F.lit(True).alias("_cut"))


def busy_cuts(flat: DataFrame, key: str, time_us: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame | None:
    """(key, _cuts): times that cut each object of more than ``chunk_rows`` rows into parts of about as many; None when there is none.

    One count per object; only if some object is busy, a sketch of the times of the busy ones.
    """
    busy = flat.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows)
    if busy.isEmpty():
        return None
    times = flat.select(key, time_us).join(busy, key, "left_semi")
    steps = [i / CUTS for i in range(1, CUTS)]
    sketch = times.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(time_us, steps, 10 * CUTS).alias("_q"))
    parts = F.least(F.ceil(F.col("_n") / F.lit(chunk_rows)), F.lit(CUTS)).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_q", F.floor(i * F.lit(CUTS) / parts).cast("int") - 1))
    return reliable_checkpoint(sketch.select(key, F.array_distinct(cuts).alias("_cuts")))


def _count_chunks(flat: DataFrame, key: str, time_us: str, window_us: int, cuts: DataFrame) -> DataFrame:
    """As ``_time_chunks``, by the objects' own cuts; an object without any is one chunk."""
    t = F.col(time_us)
    few = len(cuts.limit(BROADCAST_BUSY + 1).select(key).take(BROADCAST_BUSY + 1)) <= BROADCAST_BUSY
    joined = flat.join(F.broadcast(cuts) if few else cuts, key, "left")
    at = lambda x: F.coalesce(F.size(F.filter("_cuts", lambda c: c <= x)), F.lit(0)).cast("long")
    own = joined.select(*flat.columns, at(t).alias("_chunk0"), at(t + F.lit(window_us)).alias("_last"), F.col("_cuts").isNotNull().alias("_cut"))
    return own.withColumn("_last", F.when(F.col("_cut"), F.col("_last")).otherwise(F.lit(0)))


def build_history(
    flat: DataFrame,
    key: str,
    time_us: str,
    items: Mapping[str, Column],
    window_us: int = 30 * DAY_US,
    chunk_us: int | None = None,
    running_count: Mapping[str, Column] | None = None,
    running_min: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    tie: str | None = None,
    chunk_rows: int = CHUNK_ROWS,
    tasks: int | None = None,
) -> DataFrame:
    """Attach history arrays and running aggregates to every flat row.

    ``items``: output column -> struct expression; each output is the sorted
    list of that struct over the object's rows in ``[t - window_us, t - 1]``
    (structs sort by their first fields, so put the time first).
    ``running_count`` / ``running_min``: output -> expression counted / minimised
    over all rows of the object up to and including ``t``.
    ``following``: output -> expression of the object's next row by time (then by
    the column ``tie``); NULL for its last row.

    Plan: objects are counted first. Where none has more than ``chunk_rows``
    rows, one shuffle by object and one window do it. A busy object is cut at
    quantiles of its times into chunks of about ``chunk_rows`` rows, however
    its rows are spread; rows within ``window_us`` of later chunks are copied
    into them as halo. Per-chunk totals are prefix-summed over an object's
    chunks, so the running aggregates need no window over a whole object
    either; a chunk's last row takes its following row from the first one of
    the next chunk. With ``chunk_us`` all objects are cut into chunks of that
    length instead, without a look at the data. ``tasks``: number of partitions
    of the result, each with whole objects or chunks. Rows with a history aren't
    sorted or shuffled.
    """
    if (chunk_us is not None and chunk_us <= 0) or chunk_rows <= 0 or window_us < 0:
        raise ValueError("chunks must be positive and window_us non-negative")
    running_count = dict(running_count or {})
    running_min = dict(running_min or {})
    following = dict(following or {})
    order = [time_us, *([tie] if tie else [])]
    if chunk_us is not None:
        dealt = _time_chunks(flat, time_us, window_us, chunk_us)
    else:
        cuts = busy_cuts(flat, key, time_us, chunk_rows)
        dealt = _count_chunks(flat, key, time_us, window_us, cuts) if cuts is not None else None
    if dealt is None:
        rows = flat.select("*", F.lit(0).cast("long").alias("_chunk"), F.lit(True).alias("_own"))
    else:
        # one scan: a row is emitted for its own chunk and, as halo, for every later one whose rows can still see it
        rows = dealt.select(*flat.columns, "_chunk0", F.explode(F.sequence("_chunk0", "_last")).alias("_chunk"))
        rows = rows.withColumn("_own", F.col("_chunk") == F.col("_chunk0")).drop("_chunk0")

    if dealt is not None and (running_count or running_min or following):
        aggs = [F.count(e).alias(f"_n_{k}") for k, e in running_count.items()]
        aggs += [F.min(e).alias(f"_m_{k}") for k, e in running_min.items()]
        if following:
            aggs.append(F.min(F.struct(*order, *[e.alias(f"_f_{k}") for k, e in following.items()])).alias("_first"))
        per_chunk = dealt.where("_cut").withColumnRenamed("_chunk0", "_chunk").groupBy(key, "_chunk").agg(*aggs)
        before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        prior = per_chunk.select(
            key, "_chunk",
            *[F.coalesce(F.sum(f"_n_{k}").over(before), F.lit(0)).alias(f"_pn_{k}") for k in running_count],
            *[F.min(f"_m_{k}").over(before).alias(f"_pm_{k}") for k in running_min],
            *([F.lead("_first").over(Window.partitionBy(key).orderBy("_chunk")).alias("_next_chunk")] if following else []),
        )
        rows = rows.join(prior, [key, "_chunk"], "left")

    if tasks:
        rows = rows.repartition(tasks, key, *([] if dealt is None else ["_chunk"]))
    if following:
        # halo rows come before a chunk's own rows, so what follows an own row is its own too; first of the windows, so that its order serves the others and rows are sorted without a history
        ahead = F.lead(F.struct(*order, *[e.alias(f"_f_{k}") for k, e in following.items()])).over(Window.partitionBy(key, "_chunk").orderBy(*order))
        rows = rows.select("*", ahead.alias("_ahead"))
    w = Window.partitionBy(key, "_chunk").orderBy(time_us)
    hist_w = w.rangeBetween(-window_us, -1)
    upto_w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = [F.sort_array(F.collect_list(e).over(hist_w)).alias(name) for name, e in items.items()]
    counts = {k: F.count(F.when(F.col("_own"), e)).over(upto_w) for k, e in running_count.items()}
    least = {k: F.min(F.when(F.col("_own"), e)).over(upto_w) for k, e in running_min.items()}
    out += [(n if dealt is None else n + F.coalesce(F.col(f"_pn_{k}"), F.lit(0))).cast("int").alias(k) for k, n in counts.items()]
    out += [(m if dealt is None else F.least(m, F.col(f"_pm_{k}"))).alias(k) for k, m in least.items()]
    if following:
        out.append((F.col("_ahead") if dealt is None else F.coalesce("_ahead", "_next_chunk")).alias("_following"))
    given = rows.select(*flat.columns, "_own", *out).where(F.col("_own"))
    after = [F.col(f"_following._f_{k}").alias(k) for k in following]
    return given.select(*[c for c in given.columns if c not in ("_own", "_following")], *after)
