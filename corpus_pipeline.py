"""Training-corpus pipeline: five stages over ``documents``, each written and read again before the next.

Every stage but the last returns the columns it got, whatever others the table
has. A document is an id with a text: rows that share an id but not the text are
judged one by one, rows equal in both stay or go together, also with a null id.
A null text counts as an empty one. An empty or wordless text is near to nothing
and holds no window; whether the classifier rejects it is learned. Ties between
near duplicates go to the smallest id (null before all), then to the smallest
hash of the text. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertspark.llm.bpe_codec import round_trip
from alertspark.llm.byte_cnn import classify, train
from alertspark.llm.common import Scratch
from alertspark.llm.decontam import contamination
from alertspark.llm.minhash_dedup import near_duplicates
from alertspark.llm.pii import pseudonymised
from alertspark.llm.queries import PSEUDONYM_KEY, TOKENIZER


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on the labels of these documents, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs, train(docs, labels), threshold=0.3, keep_columns=True)
    return scored.filter("_predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    rows, row = _rows(docs)
    groups = near_duplicates(rows, words=4, percent=80, id_col=row)
    return _without(rows, groups.filter("not kept"), row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows, row = _rows(docs)
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10, id_col=row)
    return _without(rows, found.filter("contaminated"), row)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms in place of personal data; n_chars follows the text."""
    out = docs.withColumn("text", pseudonymised(F.col("text"), PSEUDONYM_KEY)["text"])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and the digests of its ids and of the text decoded from them."""
    # small pieces and a small memo: the executors still hold what the stages before grew to
    return round_trip(docs, TOKENIZER, at_once=1 << 20, remembered=30_000)


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that names each, and the column: the id, or with two hashes of the text where some id stands for several texts."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    if hashed.filter("doc_id is null or a <> b").isEmpty():
        return docs.withColumn(name, F.col("doc_id")), name
    return docs.withColumn(name, F.struct("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))), name


def _without(rows: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """The documents that aren't among ``gone``; these are written first, so that Spark knows whether they are few enough to broadcast."""
    ids = Scratch(rows.sparkSession).keep(gone.select(F.col(row).alias("_gone")).distinct(), "gone")
    return rows.join(ids, rows[row].eqNullSafe(ids["_gone"]), "left_anti").drop(row)


STAGES = [
    ("quality classifier", quality_classifier),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", pii),
    ("bpe encoding and decoding", bpe),
]

ORACLE_SQL = None  # learned weights, pseudonyms and token ids are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage-{i}")
            scratch.drop(f"stage-{i - 1}")  # nothing reads it any more
    return docs
