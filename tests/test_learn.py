"""Class names as labels: the index is learned, saved with the model, and takes any class."""

import numpy as np
from pyspark.sql import functions as F

from alertspark.operators import learn


def _frame(spark, classes, n=900, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = i % len(classes)
        x, y = rng.normal(6 * np.cos(k), 1), rng.normal(6 * np.sin(k), 1)
        rows.append((f"o{i // 2}", i, float(x), None if i % 50 == 0 else float(y), None if i % 90 == 7 else classes[k]))
    return spark.createDataFrame(rows, "obj string, id long, x double, y double, label string")


def test_a_sixth_class_is_learned_and_kept(spark, tmp_path):
    classes = ["click", "error", "purchase", "signup", "view", "zz top"]
    df = _frame(spark, classes)
    spec = learn.MLSpec(feature_cols=["x", "y"], kind="lr", n_classes=0)
    out = learn.fit_and_score(df, spec, F.lit(True), F.col("obj"), "p", keep=["obj", "id"])
    rows = out.join(df.select("id", F.col("label").alias("truth")), "id").filter(~learn.split_flag(F.col("obj"))).collect()
    assert len(rows) > 200 and all(len(r.p.probabilities) == 6 and abs(sum(r.p.probabilities) - 1) < 1e-6 for r in rows)
    assert all(r.p.name == classes[r.p.best] for r in rows)
    known = [r for r in rows if r.truth is not None]
    assert np.mean([r.p.name == r.truth for r in known]) > 0.9 and {r.p.name for r in known} == set(classes)

    model = learn.fit(df.filter("label is not null"), spec)
    learn.save_model(model, str(tmp_path / "m"))
    new = df.drop("label").limit(50)
    a, b = (learn.score(m, new, spec, F.lit(True), "p").select("id", "p.name").collect() for m in (model, learn.load_model(str(tmp_path / "m"))))
    assert sorted(a) == sorted(b) and {r.name for r in a} <= set(classes)


def test_unknown_names_at_scoring_are_no_class(spark):
    df = _frame(spark, ["a", "b"], 200)
    spec = learn.MLSpec(feature_cols=["x", "y"], kind="lr", n_classes=0)
    model = learn.fit(df.filter("label is not null"), spec)
    rows = learn.score(model, df.withColumn("label", F.lit("never seen")), spec, F.col("id") % 3 == 0, "p").collect()
    assert len(rows) == 200 and all((r.p is None) == (r.id % 3 > 0) for r in rows)
    assert {r.p.name for r in rows if r.p} == {"a", "b"} and all(len(r.p.probabilities) == 2 for r in rows if r.p)
