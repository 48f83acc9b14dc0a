"""Supervised science modules: cuts -> curve features -> pyspark.ml classifier.

No weights or training tables ship with the contract, so every module is a
three-stage job with its own fit: *cuts* are native column expressions and
*features* sums over Arrow batches (both checked by SQL), *fit/score* is a ``pyspark.ml`` pipeline
trained on a split by ``xxhash64(object id)`` (never by row, so an object is
never on both sides). Rows failing the cuts score 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertspark.functions.arrays import aligned, doubles, let, nullable, of_band, stay
from alertspark.session import reliable_checkpoint

# Cross-match labels that do not rule out an extragalactic transient (fixed list).
ALLOWED_XMATCH = ["Unknown", "Candidate_SN*", "SN", "Transient", "Fail"]
CURVE_FEATURES = ["n", "peak", "last", "mean", "slope", "rise_frac", "span", "err_mean"]
SNN_SLOTS = 16


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _fold(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))


def curve_numbers(row: np.ndarray, t: tuple, y: np.ndarray, e: tuple, n: int, brighter: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """CURVE_FEATURES, each with where it is NULL, of ``n`` rows from one band's detections.

    Points come by row and in time order; sums run in that order. ``t`` and
    ``e`` are (values, where NULL); times count from the row's first detection.
    """
    fold = lambda x: np.bincount(row, x, n)
    some = lambda x: np.bincount(row[x], minlength=n) > 0
    over = lambda a, b: (np.divide(a, b, out=np.zeros(n), where=b != 0), b == 0)
    count = np.bincount(row, minlength=n)
    nd, seen = count.astype(float), count > 0
    first = np.searchsorted(row, np.arange(n))
    last = (first + count - 1)[seen]
    t, no_time = t[0] - t[0][first[row]], t[1] | t[1][first[row]]
    peak, final, span, timeless = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n, bool)
    if seen.any():
        peak[seen] = (np.fmin if brighter == "lower" else np.maximum).reduceat(y, first[seen])  # as Spark orders them, NaN is the greatest
        final[seen], span[seen], timeless[seen] = y[last], t[last], no_time[last]
    mean, none = over(fold(y), nd)
    mt, _ = over(fold(t), nd)
    off = t - mt[row]
    slope, flat = over(fold(off * (y - mean[row])), fold(off * off))
    step, same = np.diff(y), row[1:] == row[:-1]
    up = step < 0 if brighter == "lower" else ~(step <= 0)
    rise, _ = over(np.bincount(row[1:][up & same], minlength=n).astype(float), nd - 1)
    err, _ = over(fold(e[0]), nd)
    few = count < 2
    return {"n": (count, np.zeros(n, bool)), "peak": (peak, ~seen), "last": (final, ~seen), "mean": (mean, none), "slope": (slope, few | flat | some(no_time)),
            "rise_frac": (rise, few), "span": (span, timeless), "err_mean": (err, none | some(e[1]))}


def add_curve_features(df: DataFrame, bands: Sequence, prefix: str, t: str, y: str, e: str, band_col: str,
                       brighter: str, fixed: bool = False) -> DataFrame:
    """Adds ``<prefix><band>`` structs (one per band) of CURVE_FEATURES, made for all rows of an Arrow batch at once.

    ``brighter`` is 'lower' (magnitudes) or 'higher' (fluxes). Detections are
    the points with a value; NULL arrays make NULL features. ``fixed``: the
    step stays where it is (``stay``), as it must above arrays made by nested lambdas.
    """
    def numbers(t: pa.Array, y: pa.Array, e: pa.Array, b: pa.Array) -> pa.Array:
        there, row, (t, y, e, b) = aligned(t, y, e, b)
        (t, t0), (y, y0), (e, e0), made = doubles(t), doubles(y), doubles(e), []
        with np.errstate(all="ignore"):
            for band in bands:
                own = of_band(b, band) & ~y0
                cols = curve_numbers(row[own], (t[own], t0[own]), y[own], (e[own], e0[own]), len(there), brighter)
                made.append(pa.StructArray.from_arrays([nullable(v, null | ~there, pa.int32() if k == "n" else None) for k, (v, null) in cols.items()], list(cols)))
        return pa.StructArray.from_arrays(made, [f"of_{b}" for b in bands])

    one = ", ".join(f"{k}: {'int' if k == 'n' else 'double'}" for k in CURVE_FEATURES)
    made = F.arrow_udf(numbers, f"struct<{', '.join(f'of_{b}: struct<{one}>' for b in bands)}>")
    d = df.withColumn("_curves", (stay(made) if fixed else made)(t, y, e, band_col))
    return d.select(*df.columns, *[F.col(f"_curves.of_{b}").alias(f"{prefix}{b}") for b in bands])


def flatten_curve_features(bands: Sequence, prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{b}.{k}").cast("double").alias(f"{prefix}{b}_{k}") for b in bands for k in CURVE_FEATURES]


def resampled_curve(t: str, y: str, band_col: str, band, slots: int = SNN_SLOTS) -> Column:
    """Magnitudes of one band on ``slots`` equal steps of the alert's whole light curve.

    The steps run from the alert's first to its last detection in any band;
    each holds the mean of the band's detections in it (NULL where there is
    none), so every detection counts."""
    pts = F.filter(F.arrays_zip(F.col(t).alias("t"), F.col(y).alias("y"), F.col(band_col).alias("b")), lambda p: p["y"].isNotNull())
    bounds = lambda z: F.struct(z.alias("z"), F.array_min(F.transform(z, lambda p: p["t"])).alias("a"),
                                F.array_max(F.transform(z, lambda p: p["t"])).alias("b"))

    def steps(s):
        at = lambda p: F.when(s["b"] > s["a"], F.least(F.floor((p["t"] - s["a"]) / (s["b"] - s["a"]) * slots).cast("int"),
                                                       F.lit(slots - 1))).otherwise(F.lit(0))
        placed = F.transform(F.filter(s["z"], lambda p: p["b"] == F.lit(band)), lambda p: F.struct(at(p).alias("i"), p["y"].alias("y")))
        return let(placed, lambda q: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: let(
            F.filter(q, lambda p: p["i"] == i), lambda r: _div(_fold(r, lambda p: p["y"]), F.size(r).cast("double")))))

    return let(let(pts, bounds), steps)


# ------------------------------------------------------------------ fit / score


def split_flag(key: Column, train_share: float = 0.7) -> Column:
    """Deterministic object-level split: True = training side."""
    return F.pmod(F.xxhash64(key), F.lit(1000)) < F.lit(int(train_share * 1000))


@dataclass
class MLSpec:
    feature_cols: list[str]
    label_col: str = "label"
    kind: str = "rf"  # rf | gbt | mlp | lr
    n_classes: int = 2  # 0: as many as the labels have, which may then be names
    seed: int = 42
    params: dict = field(default_factory=dict)


def _estimator(spec: MLSpec, n_features: int, label: str):
    if spec.kind == "rf":
        return RandomForestClassifier(labelCol=label, featuresCol="_fv", seed=spec.seed,
                                      numTrees=spec.params.get("numTrees", 30), maxDepth=spec.params.get("maxDepth", 6))
    if spec.kind == "gbt":
        return GBTClassifier(labelCol=label, featuresCol="_fv", seed=spec.seed,
                             maxIter=spec.params.get("maxIter", 20), maxDepth=spec.params.get("maxDepth", 4))
    if spec.kind == "mlp":
        hidden = spec.params.get("hidden", [16])
        return MultilayerPerceptronClassifier(labelCol=label, featuresCol="_fv", seed=spec.seed,
                                              layers=[n_features, *hidden, spec.n_classes], maxIter=100)
    if spec.kind == "lr":
        return LogisticRegression(labelCol=label, featuresCol="_fv", family="multinomial",
                                  maxIter=spec.params.get("maxIter", 50))
    raise ValueError(f"unknown model kind {spec.kind!r}")


def with_missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_missing`` (1.0 where NULL or NaN), so that an absent value isn't read as a number."""
    gone = {f"{c}_missing": (F.col(c).isNull() | F.isnan(c)).cast("double") for c in cols}
    return df.withColumns({**gone, **{c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in cols}})


def fit(train: DataFrame, spec: MLSpec) -> PipelineModel:
    """Median imputation, missing flags, scaling, classifier. The pipeline saves and loads as one (``save_model``).

    Labels that are names are numbered in their order by a stage of the
    pipeline, so the classes are those of the training rows and stay with the model.
    """
    cols, flags = list(spec.feature_cols), [f"{c}_missing" for c in spec.feature_cols]
    data = with_missing_flags(train, cols)
    some = data.agg(*[F.count(F.when(~F.isnan(c), 1)).alias(c) for c in cols]).first()
    usable = [c for c in cols if some[c]]  # a column without any value has no median; its flag stands for it
    if not some or not usable:
        raise ValueError("no training row has a feature value")
    filled = [f"{c}_filled" for c in usable]
    stages = [Imputer(strategy="median", inputCols=usable, outputCols=filled),
              VectorAssembler(inputCols=filled + flags, outputCol="_raw", handleInvalid="keep"),
              StandardScaler(inputCol="_raw", outputCol="_fv", withMean=True, withStd=True),
              _estimator(spec, len(filled) + len(flags), "_class" if spec.n_classes == 0 else spec.label_col)]
    if spec.n_classes == 0:
        stages.insert(0, StringIndexer(inputCol=spec.label_col, outputCol="_class", stringOrderType="alphabetAsc", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(data)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame, spec: MLSpec, cuts: Column, out: str) -> DataFrame:
    """Binary: probability of class 1; multi-class: struct(probabilities, best class, its name when the labels are names). 0.0 where cuts fail."""
    nulls = {f"_given_{c}": F.col(c) for c in spec.feature_cols}
    scored = model.transform(with_missing_flags(df.withColumns(nulls), spec.feature_cols))
    prob = vector_to_array(F.col("probability"))
    if spec.n_classes == 2:
        p1 = F.when(F.size(prob) > 1, F.get(prob, 1)).otherwise(F.lit(0.0))
        val = F.when(cuts, p1).otherwise(F.lit(0.0))
    else:
        names = next((s.labels for s in model.stages if isinstance(s, StringIndexerModel)), None)
        best = F.col("prediction").cast("int")
        if names is not None:  # the place kept for unknown names is no class
            prob, best = F.slice(prob, 1, len(names)), F.least(best, F.lit(len(names) - 1))
        called = [F.get(F.array(*[F.lit(n) for n in names]), best).alias("name")] if names else []
        val = F.when(cuts, F.struct(prob.alias("probabilities"), best.alias("best"), *called))
    helpers = [f"{c}{e}" for c in spec.feature_cols for e in ("_missing", "_filled")]
    scored = scored.withColumn(out, val).drop("_class", "_raw", "_fv", "rawPrediction", "probability", "prediction", *helpers)
    return scored.withColumns({c: F.col(f"_given_{c}") for c in spec.feature_cols}).drop(*nulls)


def fit_and_score(df: DataFrame, spec: MLSpec, cuts: Column, key: Column, out: str,
                  model: PipelineModel | None = None, keep: list[str] | None = None,
                  materialize: bool = True) -> DataFrame:
    """Fit on the training side of the object split (labelled rows passing the cuts), score every row.

    Learners make several passes over their input, which would otherwise
    recompute the whole upstream plan each time, so what the fit reads is
    checkpointed once to the shared folder: the narrow frame (``keep`` + label +
    flags + features), or without ``keep`` only label and features of the
    training rows. With a fitted ``model`` nothing is written.
    """
    d = df.withColumn("_cuts", F.coalesce(cuts, F.lit(False))).withColumn("_train", split_flag(key))
    if keep is not None:
        d = d.select(*keep, spec.label_col, "_cuts", "_train", *spec.feature_cols)
    if model is None:
        known = F.col("_train") & F.col("_cuts") & F.col(spec.label_col).isNotNull()
        train = d.where(known)
        if keep is None:  # only what the fit reads is written; the wide frame is scored lazily
            train = train.select(spec.label_col, *spec.feature_cols)
        elif materialize:
            d = reliable_checkpoint(d)
            train = d.where(known)
        model = fit(reliable_checkpoint(train) if materialize and keep is None else train, spec)
    return score(model, d, spec, F.col("_cuts"), out).drop("_cuts", "_train")
