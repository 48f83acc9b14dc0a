"""Scores from exported trees and weights equal the pipeline's; models beat chance on a planted signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertspark.operators import learn, model_scores


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        y = i % 2
        x = [rng.normal(0.9 * y, 1), rng.normal(-0.6 * y, 1), rng.normal(0, 1)]
        rows.append((f"o{i // 3}", i, float(y), *(None if rng.random() < 0.15 else float(v) for v in x), None))
    return spark.createDataFrame(rows, "obj string, id long, label double, a double, b double, c double, never double")


@pytest.mark.parametrize("kind", ["rf", "gbt", "lr", "mlp"])
def test_exported_model_scores_the_same_and_beats_chance(spark, frame, kind):
    cols = ["a", "b", "c", "never"]
    spec = learn.MLSpec(feature_cols=cols, kind=kind)
    train = learn.split_flag(F.col("obj"))
    model = learn.fit(frame.where(train), spec)
    shipped = model_scores.exported(model, cols, spark)
    scored = learn.score(model, frame.repartition(5), spec, F.lit(True), "p")
    rows = model_scores.rescored(scored, shipped, "q").where(~train).select("label", "p", "q").collect()
    assert len(rows) > 300 and max(abs(r.p - r.q[1]) for r in rows) < 1e-9 and all(abs(sum(r.q) - 1) < 1e-9 for r in rows)
    good, bad = ([r.p for r in rows if r.label == y] for y in (1.0, 0.0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.65, auc


def test_other_models_are_refused(spark, frame):
    from pyspark.ml import PipelineModel

    model = learn.fit(frame, learn.MLSpec(feature_cols=["a", "b"], kind="lr"))
    with pytest.raises(ValueError, match="exported"):
        model_scores.exported(PipelineModel(model.stages[:-1]), ["a", "b"], spark)
