"""User-function surface: scalar, vectorised and grouped hooks.

Native column expressions come first everywhere in this package; these
wrappers are for user code that cannot be written as SQL. The plain Python
function stays importable (``.func``) and is unit-tested directly.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scalar_udf(fn: Callable, return_type) -> Callable[..., Column]:
    """Row-at-a-time function (Arrow-serialised). Slow path: use for nested results only."""
    u = F.udf(fn, return_type, useArrow=True)
    u.func = fn
    return u


def vectorised_udf(fn: Callable[..., pd.Series], return_type) -> Callable[..., Column]:
    """Series in, Series out over Arrow batches."""
    u = F.pandas_udf(fn, return_type)
    u.func = fn
    return u


#: Rows of a key from which its rows are dealt over several sub-groups of about as many.
PART_ROWS = 20_000


def grouped_apply(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                  combine: dict[str, str], salt_col: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Grouped user function made safe for very large groups.

    ``fn`` maps one sub-group to partial results with the columns named in
    ``combine``; the partials of a key are then merged natively with the given
    aggregate (``"sum"``, ``"min"``, ``"max"``). A key of at most ``part_rows``
    rows is one sub-group, since each costs a call; a larger one is dealt by
    ``xxhash64(salt_col)`` over as many as its rows ask for, so no task ever
    holds a whole large group. A NULL key is a key like any other.
    """
    parts = F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).cast("int")
    busy = df.groupBy(*keys).agg(parts.alias("_parts")).where("_parts > 1").select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_parts")
    same = functools.reduce(lambda a, b: a & b, [df[k].eqNullSafe(busy[f"_key_{k}"]) for k in keys])
    dealt = F.pmod(F.xxhash64(F.col(salt_col)), F.coalesce(F.col("_parts"), F.lit(1))).cast("int")
    salted = df.join(busy, same, "left").select(*df.columns, dealt.alias("_salt"))
    full_schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [schema])
    partial = salted.groupBy(*keys, "_salt").applyInPandas(fn, full_schema)
    aggs = [getattr(F, how)(c).alias(c) for c, how in combine.items()]
    return partial.groupBy(*keys).agg(*aggs)


# ------------------------------------------------------------------ example hooks used by the registered queries


def detection_summary(mags: list | None) -> dict | None:
    """Plain function: number of detections and their mean magnitude (left-to-right sum)."""
    if mags is None:
        return None
    det = [m for m in mags if m is not None]
    s = 0.0
    for m in det:
        s = s + m
    return {"n_det": len(det), "mean_mag": s / len(det) if det else None}


DETECTION_SUMMARY_TYPE = T.StructType([T.StructField("n_det", T.IntegerType()),
                                       T.StructField("mean_mag", T.DoubleType())])


def snr_from_sigma(sigma: pd.Series) -> pd.Series:
    """Plain function: signal-to-noise ratio of a magnitude error, 1.0857 / sigma."""
    return 1.0857 / sigma


def partial_mag_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Plain function: per sub-group detection count and magnitude sum."""
    det = pdf["magpsf"].dropna()
    out = pdf.iloc[:1][[c for c in pdf.columns if c not in ("magpsf", "_salt")]].copy()
    out["n_det"] = int(len(det))
    out["mag_sum"] = float(det.sum()) if len(det) else 0.0
    return out.reset_index(drop=True)
