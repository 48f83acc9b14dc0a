"""Scores from a fitted pipeline's own numbers, without the pipeline.

``exported`` takes a fitted ``learn.fit`` pipeline apart: medians, scaling, and
the nodes of its trees or the weights of its linear model or layers. ``rescored`` applies
them in one Arrow function over the raw feature columns: the form in which a
model travels to a place without ``pyspark.ml``, and an independent check of
the pipeline's scores. What is shipped is bounded by the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import ImputerModel, StandardScalerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertspark.session import shared_path


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # a leaf's class shares, or its prediction

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (inner := self.feature[at] >= 0).any():
            less = x[np.arange(len(x)), np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(less, self.left[at], self.right[at]), at)
        return self.value[at]


@dataclass
class Exported:
    features: list[str]
    filled: list[int]  # places of the features that have a median
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    kind: str  # rf | gbt | lr | mlp
    trees: list[Tree]
    weights: np.ndarray  # of the trees
    layers: list[tuple[np.ndarray, np.ndarray]]  # weights (out x in) and bias; a linear model is one layer

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of rows of raw features (NaN: missing)."""
        gone = np.isnan(x)
        inputs = np.hstack([np.where(gone[:, self.filled], self.median, x[:, self.filled]), gone.astype(float)]) - self.mean
        inputs = inputs * np.divide(1.0, self.std, out=np.zeros_like(self.std), where=self.std != 0)
        if self.kind == "rf":
            return sum(t(inputs) for t in self.trees) / len(self.trees)
        if self.kind == "gbt":
            p = 1 / (1 + np.exp(-2 * sum(w * t(inputs) for w, t in zip(self.weights, self.trees))))
            return np.stack([1 - p, p], axis=1)
        z = inputs
        for i, (w, b) in enumerate(self.layers):
            z = (1 / (1 + np.exp(-np.clip(z, -500, 500))) if i else z) @ w.T + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _trees(model, spark) -> list[Tree]:
    """The nodes as the model saves them; there are as many as it says it has."""
    path = shared_path(spark, "model")
    model.write().overwrite().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    nodes = n.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
                     F.get("split.leftCategoriesOrThreshold", 0).alias("threshold")).toPandas().sort_values(["treeID", "id"])
    out = []
    for _, g in nodes.groupby("treeID"):
        leaf = (g["leftChild"] < 0).to_numpy()
        if isinstance(model, RandomForestClassificationModel):
            counts = np.stack(g["impurityStats"].to_numpy())
            value = counts / counts.sum(axis=1, keepdims=True)
        else:
            value = g["prediction"].to_numpy()
        out.append(Tree(np.where(leaf, -1, g["feature"]), g["threshold"].fillna(0.0).to_numpy(float), g["leftChild"].to_numpy(), g["rightChild"].to_numpy(), value))
    return out


def _layers(model: MultilayerPerceptronClassificationModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each layer's weights, stored by column, then its bias."""
    flat, at, out = model.weights.toArray(), 0, []
    sizes = list(model.getOrDefault("layers"))
    for m, n in zip(sizes, sizes[1:]):
        out.append((flat[at : at + m * n].reshape(m, n).T, flat[at + m * n : at + m * n + n]))
        at += m * n + n
    return out


def exported(model: PipelineModel, feature_cols: list[str], spark) -> Exported:
    stage = lambda kind: next((s for s in model.stages if isinstance(s, kind)), None)
    imputer, scaler = stage(ImputerModel), stage(StandardScalerModel)
    medians = imputer.surrogateDF.first().asDict()
    filled = [i for i, f in enumerate(feature_cols) if f in medians]
    common = dict(features=list(feature_cols), filled=filled, median=np.array([medians[feature_cols[i]] for i in filled]), mean=scaler.mean.toArray(), std=scaler.std.toArray())
    if (m := stage(RandomForestClassificationModel)) is not None:
        return Exported(**common, kind="rf", trees=_trees(m, spark), weights=np.zeros(0), layers=[])
    if (m := stage(GBTClassificationModel)) is not None:
        return Exported(**common, kind="gbt", trees=_trees(m, spark), weights=np.array(m.treeWeights), layers=[])
    if (m := stage(LogisticRegressionModel)) is not None:
        return Exported(**common, kind="lr", trees=[], weights=np.zeros(0), layers=[(m.coefficientMatrix.toArray(), m.interceptVector.toArray())])
    if (m := stage(MultilayerPerceptronClassificationModel)) is not None:
        return Exported(**common, kind="mlp", trees=[], weights=np.zeros(0), layers=_layers(m))
    raise ValueError("only forests, boosted trees, logistic models and perceptrons can be exported")


def rescored(df: DataFrame, model: Exported, out: str) -> DataFrame:
    """Adds ``out``: the class probabilities (array) from the raw feature columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def probabilities(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.astype("float64").to_numpy() for c in cols])
        return pd.Series(list(shared.value.probabilities(x)))

    udf = F.pandas_udf(probabilities, T.ArrayType(T.DoubleType()))
    return df.withColumn(out, udf(*[F.col(c).cast("double") for c in model.features]))
