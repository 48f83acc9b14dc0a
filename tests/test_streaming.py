"""A stream over the alert archive scores every alert exactly once."""

from pyspark.sql import functions as F

from alertspark.session import shared_path
from alertspark.sources import fixtures as fx
from alertspark.streaming.alerts import batch_scorer, read_alert_stream, start_scoring
from conftest import SF_SMALL


def test_stream_scores_all_alerts(spark):
    root = fx.alert_archive(spark, SF_SMALL)
    schema = spark.read.parquet(root).schema
    stream = read_alert_stream(spark, root, schema, max_files_per_trigger=8)
    scorer = batch_scorer(["Asteroid", "Fast transient"], {"max_gap_days": 1.0},
                          select=["candid", "roid", "year", "month", "day"])
    out, ck = shared_path(spark, "stream-out"), shared_path(spark, "stream-ckpt")
    q = start_scoring(stream, scorer, out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == spark.read.parquet(root).count()
    assert got.select("candid").distinct().count() == got.count()
    batch = scorer(spark.read.parquet(root)).select("candid", "roid")
    assert got.select("candid", "roid").exceptAll(batch).count() == 0
