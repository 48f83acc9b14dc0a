"""The pipeline on the small tables: each stage takes effect and keeps clean documents."""

import __spark_entry__ as E
import corpus_pipeline as P
from conftest import SF_SMALL

from alertspark.llm.common import Scratch
from alertspark.llm.decontam import contamination
from alertspark.llm.queries import TOKENIZER


def test_stages_one_by_one(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    columns, scratch, rows = docs.columns, Scratch(spark), [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, SF_SMALL), "stage")
        assert docs.columns == columns
        rows.append(docs.count())
        if name == "minhash near-dedup":
            again = P.near_duplicates(docs, words=4, percent=80)
            assert again.filter("not kept").isEmpty()
        if name == "benchmark decontamination":
            assert contamination(docs, bench).filter("contaminated").isEmpty()
    assert rows[0] > rows[1] > 0.7 * rows[0] and rows[1] > rows[2] > 0.6 * rows[1] and rows[2] >= rows[3] == rows[4] > 0.8 * rows[2]
    last = P.STAGES[-1][1](spark, docs, SF_SMALL)
    lib = Tokenizer.from_file(TOKENIZER)
    want = {r["doc_id"]: len(lib.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in last.collect()} == want
    assert sorted(r["doc_id"] for r in P.run(spark, SF_SMALL).select("doc_id").collect()) == sorted(want)


def test_registered():
    assert E.queries()["pipeline"].__wrapped__ is P.run
    numbers = {n.split("_")[0] for n in E.queries() if n.startswith("op")}
    assert numbers == {f"op{i}" for i in range(1, 14)}


def test_null_ids_and_empty_table(spark):
    rows = [(None, "the same text of nine words stands here twice", "en", "s", 1), (None, "the same text of nine words stands here twice", "en", "s", 1), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in P.STAGES[1:]:
            assert stage(spark, df, SF_SMALL).count() == df.count()
        assert P.STAGES[0][1](spark, df, SF_SMALL).count() <= df.count()


def test_one_id_on_two_texts(spark):
    long = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").filter("size(split(text, ' ')) >= 12").first()["text"]
    own = " ".join(f"other{i}" for i in range(60))
    rows = [(1, long), (5, long), (5, own), (7, f"{own[:30]} {item} end"), (7, "a text of its own"), (None, long), (None, own + " more")]
    docs = spark.createDataFrame([(i, t, "en", t) for i, t in rows], "doc_id long, text string, lang string, t1 string")
    kept = P.near_dedup(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    # of the three rows with the long text that with the null id stays, of the two with the own text (near to each other) too
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, long), (0, own + " more"), (7, rows[3][1]), (7, "a text of its own")])
    clean = P.decontamination(spark, docs, SF_SMALL)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in clean.collect()) == sorted((i or 0, t) for i, t in rows if item not in t)

