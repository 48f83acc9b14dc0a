"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertspark.llm import warc
from alertspark.llm.bpe_codec import round_trip
from alertspark.llm.byte_cnn import score_quality
from alertspark.llm.collocations import collocations
from alertspark.llm.decontam import contamination
from alertspark.llm.license_scan import scan_licenses
from alertspark.llm.minhash_dedup import near_duplicates
from alertspark.llm.oracles import ORACLE_SQL  # noqa: F401
from alertspark.llm.pii import pseudonymise
from alertspark.llm.site_style import main_text
from alertspark.llm.token_count import count_tokens
from alertspark.llm.toxic_gru import score_toxicity
from alertspark.llm.weak_rules import weak_quality
from alertspark.llm.word_runs import periodic_runs

#: The tokenizer file; a parameter of the operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Key of the pseudonyms; a deployment passes its own secret to ``pseudonymise``.
PSEUDONYM_KEY = "documents-2024"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op2_site_style_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no capture time: one page a second, in the order of ids
    return warc.round_trip(_table(spark, sf_dir, "pages"), ts=F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")))


def op4_weak_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(_table(spark, sf_dir, "documents"))


def op5_prefix_join_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), TOKENIZER, limit=1024)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)


def op10_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, percent=100)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word order that the contract of op12 asks for: one document in ten repeats a stretch of itself up to its end."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g, i = h // 10, np.arange(n)
    a = g % n
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_table(spark, sf_dir, "documents"), least=6, times=4, order=planted)
    # greatest length / period, compared by products; the first of equals
    better = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


QUERIES = {f.__name__: f for f in (
    op1_feistel_pseudonyms,
    op2_site_style_text,
    op3_warc_round_trip,
    op4_weak_quality_rules,
    op5_prefix_join_decontamination,
    op6_byte_cnn_quality,
    op7_license_scan,
    op8_token_counts,
    op9_bpe_round_trip,
    op10_b_bit_minhash,
    op11_collocations,
    op12_periodic_runs,
    op13_toxicity_gru,
)}
