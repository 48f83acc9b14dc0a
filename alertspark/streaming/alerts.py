"""Score alerts as they arrive.

Each alert row already carries its history, so the per-alert modules need no
streaming state: new parquet files under an alert folder are read with
``readStream``, every micro-batch goes through the same batch plan
(``foreachBatch``: light curves -> modules, including joins with large
catalogues that a stream-static join could not shuffle-aggregate), and the
result is appended to a night-partitioned parquet table. Progress lives in a
checkpoint under the shared folder, so a restarted job resumes where it stopped
and a re-run batch overwrites only its own output (``batch_id`` partition).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from alertspark.operators.lightcurve import lightcurve
from alertspark.plans.modules import apply_modules


def read_alert_stream(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int = 64) -> DataFrame:
    """New alert parquet files under ``path`` (schema given up front, as streams require)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def batch_scorer(modules: Sequence[str] | str, ctx: dict | None = None,
                 select: Sequence[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The batch plan applied to every micro-batch."""
    def run(df: DataFrame) -> DataFrame:
        out = apply_modules(lightcurve(df), modules, ctx, skip_missing_inputs=True)
        return out.select(*select) if select else out

    return run


def start_scoring(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str,
                  available_now: bool = True, partition_by: Sequence[str] = ("year", "month", "day")) -> StreamingQuery:
    """Append scored micro-batches to ``out_path``; idempotent per batch id."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        scored = scorer(batch).withColumn("batch_id", F.lit(batch_id))
        (scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", *partition_by).parquet(out_path))

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
