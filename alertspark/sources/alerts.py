"""Alert sources and sinks: parquet archives, night partitions, class delivery,
catalogue tables and run-result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NIGHT_COLS = ("year", "month", "day")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert table (one row per alert) from a parquet folder."""
    return spark.read.parquet(path)


def night_filter(night: str) -> Column:
    """Predicate on the ``year/month/day`` partition columns of night ``YYYYMMDD``.

    Partition values are inferred as integers, so compare numbers (``7``, not ``"07"``).
    """
    if len(night) != 8 or not night.isdigit():
        raise ValueError(f"night must be YYYYMMDD, got {night!r}")
    y, m, d = int(night[:4]), int(night[4:6]), int(night[6:8])
    return (F.col("year") == y) & (F.col("month") == m) & (F.col("day") == d)


def read_night(spark: SparkSession, root: str, night: str) -> DataFrame:
    """One night of an archive partitioned by ``year=/month=/day=`` (partition pruning)."""
    return spark.read.parquet(root).where(night_filter(night))


#: Alerts of one file of an archive, whose histories one task sorts and writes.
FILE_ROWS = 20_000
#: Measurements in the histories of a task that makes those of whole objects and writes all their nights (about 0.4 GB); its alerts at least.
TASK_POINTS, TASK_ROWS = 4_000_000, 10_000


def write_archive(df: DataFrame, root: str, mode: str = "overwrite", file_rows: int = FILE_ROWS, key: str | None = None) -> None:
    """Write alerts partitioned by night.

    With ``key``, ``df`` comes in partitions of whole objects and bounded rows,
    and each is written as it is, sorted by night and object: histories are
    never shuffled, and those of one object and night, which repeat each other,
    are packed together.

    Without, nights are counted first (their columns only); a night's rows are dealt
    over as many tasks as they ask for, each with one night's rows alone. Sizes
    of shuffled bytes don't serve: the repeated histories shrink to a fraction
    there and are unpacked in the task.
    """
    if key is not None:
        laid = df.sortWithinPartitions(*NIGHT_COLS, key)
        laid.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", file_rows).partitionBy(*NIGHT_COLS).parquet(root)
        return
    nights = [*df.groupBy(*NIGHT_COLS).agg(F.count(F.lit(1)).alias("_n")).orderBy(*NIGHT_COLS).collect()]  # one row per night
    cells = [-(-r["_n"] // file_rows) for r in nights]
    if not nights:
        df.write.mode(mode).partitionBy(*NIGHT_COLS).parquet(root)
        return
    table = [(*[r[c] for c in NIGHT_COLS], sum(cells[:i]), cells[i]) for i, r in enumerate(nights)]
    types = ", ".join(f"_{c} {df.schema[c].dataType.simpleString()}" for c in NIGHT_COLS)
    places = df.sparkSession.createDataFrame(table, f"{types}, _first int, _cells int")
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
    same = [df[c].eqNullSafe(places[f"_{c}"]) for c in NIGHT_COLS]
    at = F.col("_first") + F.pmod(F.xxhash64(*plain), F.col("_cells")).cast("int")
    dealt = df.join(F.broadcast(places), same[0] & same[1] & same[2], "left").select(*df.columns, at.alias("_at"))
    dealt.repartitionById(sum(cells), "_at").drop("_at").write.mode(mode).partitionBy(*NIGHT_COLS).parquet(root)


def write_by_class(df: DataFrame, path: str, class_col: str = "alertclass", mode: str = "overwrite") -> None:
    """Deliver alerts partitioned by their class label."""
    df.hint("rebalance", class_col).write.mode(mode).partitionBy(class_col).parquet(path)


def read_class(spark: SparkSession, path: str, label: str, class_col: str = "alertclass") -> DataFrame:
    return spark.read.parquet(path).where(F.col(class_col) == F.lit(label))


def read_catalog(spark: SparkSession, name: str, root: str) -> DataFrame:
    """A reference catalogue stored as a parquet table ``<root>/<name>``.

    Names like ``vizier:I/355/gaiadr3`` map to a folder name with ``:`` and
    ``/`` replaced by ``_``.
    """
    safe = name.replace(":", "_").replace("/", "_")
    return spark.read.parquet(f"{root}/{safe}")


def write_catalog(df: DataFrame, name: str, root: str) -> str:
    safe = name.replace(":", "_").replace("/", "_")
    path = f"{root}/{safe}"
    df.write.mode("overwrite").parquet(path)
    return path


def save_runs(df: DataFrame, path: str) -> None:
    """Run results (one file set per version); a handful of rows, so one file."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
