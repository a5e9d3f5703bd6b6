"""Classifier factory, fitting, prediction and thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.errors import UnknownMethodError, UnsupportedParameterError
from textguard.operators.kernels import KernelFeatures
from textguard.operators.network import NetworkClassifier
from textguard.operators.sampling import train_test_split

SEED = 42

# Default hyper-parameters.
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "random_forest": {"n_estimators": 200, "max_depth": None},
    "svm": {"C": 1.0, "kernel": "rbf"},
    "lightgbm": {"n_estimators": 300, "learning_rate": 0.05},
    "mlp": {"hidden_layer_sizes": (128, 64), "max_iter": 300},
}
MODEL_KEYS = tuple(DEFAULT_PARAMS)

# Parameters understood per model. Anything else has no counterpart here and is rejected.
KNOWN_PARAMS = {
    "logistic_regression": {"C", "max_iter"},
    "random_forest": {"n_estimators", "max_depth", "min_samples_leaf", "max_features", "select_features"},
    "svm": {"C", "kernel", "gamma", "degree", "components", "max_iter", "probability"},
    "lightgbm": {"n_estimators", "learning_rate", "max_depth", "min_child_samples", "subsample", "select_features"},
    "mlp": {"hidden_layer_sizes", "max_iter"},
}
MAX_TREE_DEPTH = 30
ROWS_PER_TASK = 10_000


def resolve_params(key: str, params: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults filled in, the caller wins; unknown models and parameters are errors."""
    if key not in DEFAULT_PARAMS:
        raise UnknownMethodError(f"unknown model {key}")
    unknown = set(params or {}) - KNOWN_PARAMS[key]
    if unknown:
        raise UnsupportedParameterError(f"{key}: no counterpart for {sorted(unknown)}")
    return {**DEFAULT_PARAMS[key], **(params or {})}


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Nested override: mappings are merged, everything else is replaced."""
    return {
        k: deep_merge(base[k], over[k])
        if isinstance(base.get(k), Mapping) and isinstance(over.get(k), Mapping)
        else over.get(k, base.get(k))
        for k in {**base, **over}
    }


def _depth(value: int | None) -> int:
    if value is not None and value > MAX_TREE_DEPTH:
        raise UnsupportedParameterError(f"trees are at most {MAX_TREE_DEPTH} levels deep")
    return MAX_TREE_DEPTH if value is None else int(value)


def build_model(
    key: str, params: Mapping[str, Any] | None = None, seed: int = SEED, n_train: int = 1, n_features: int = 1, label: str = "type"
) -> Estimator:
    """A fresh classifier. ``n_train`` turns the penalty C of summed losses into Spark's mean-loss
    penalty; ``n_features`` is the width of the network input."""
    p = resolve_params(key, params)
    cols = {"featuresCol": "features", "labelCol": label}
    if key == "logistic_regression":
        return LogisticRegression(
            **cols, regParam=1.0 / (p["C"] * n_train), elasticNetParam=0.0, standardization=False, maxIter=p["max_iter"]
        )
    if key == "random_forest":
        return RandomForestClassifier(
            **cols, numTrees=p["n_estimators"], maxDepth=_depth(p["max_depth"]), seed=seed,
            minInstancesPerNode=p.get("min_samples_leaf", 1), featureSubsetStrategy=p.get("max_features", "sqrt"),
        )
    if key == "lightgbm":
        return GBTClassifier(
            **cols, maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=_depth(p.get("max_depth", 5)),
            minInstancesPerNode=p.get("min_child_samples", 20), subsamplingRate=p.get("subsample", 1.0), seed=seed,
        )
    if key == "mlp":
        return NetworkClassifier([int(u) for u in p["hidden_layer_sizes"]], p["max_iter"], **cols, seed=seed)
    if p["kernel"] not in ("linear", "rbf", "poly"):
        raise UnsupportedParameterError(f"kernel {p['kernel']}")
    return LinearSVC(
        featuresCol="features" if p["kernel"] == "linear" else "_mapped", labelCol=label,
        regParam=1.0 / (p["C"] * n_train), standardization=False, maxIter=p.get("max_iter", 100),
    )


def gamma_of(train: DataFrame, gamma: str | float, n_features: int, features: str = "features") -> float:
    """``scale`` = 1 / (d * variance of all cells), ``auto`` = 1 / d, or a number."""
    if gamma == "auto":
        return 1.0 / n_features
    if gamma != "scale":
        return float(gamma)
    row = train.agg(
        F.count("*").alias("n"), Summarizer.metrics("sum", "normL2").summary(F.col(features)).alias("s")
    ).first()
    cells = row["n"] * n_features
    mean = float(sum(row["s"]["sum"])) / cells
    var = float(sum(x * x for x in row["s"]["normL2"])) / cells - mean * mean
    return 1.0 / (n_features * var) if var > 0 else 1.0


def fit_model(
    train: DataFrame,
    key: str,
    params: Mapping[str, Any] | None = None,
    seed: int = SEED,
    label: str = "type",
    id_col: str = "doc_id",
    cached: bool = False,
) -> PipelineModel:
    """Fit one classifier on a frame with ``features`` and 0/1 labels.

    Solvers pass over the data many times, so the frame should come from a cache; ``cached`` says
    that it does, and lets a small one be read by few tasks (a large one keeps its partitions).

    Kernel machines become an explicit feature map and a linear machine. With ``probability`` the
    margin is calibrated by a logistic curve fitted on a held-out fifth, then refitted on all rows.
    """
    p = resolve_params(key, params)
    n_train = train.count()
    if cached:
        train = train.coalesce(max(1, -(-n_train // ROWS_PER_TASK)))
    n_features = int(train.select("features").first()["features"].size)
    stages: list[Transformer] = []
    frame = train
    if p.get("select_features") and p["select_features"] < n_features:
        chooser = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="_chosen", selectionMode="numTopFeatures")
        chooser.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(int(p["select_features"]))
        stages.append(chooser.fit(frame))
        frame = stages[-1].transform(frame)
    if key == "svm" and p["kernel"] != "linear":
        stages.append(
            KernelFeatures(
                kind=p["kernel"], size=p.get("components", 512), dims=n_features, degree=p.get("degree", 3),
                gamma=gamma_of(train, p.get("gamma", "scale"), n_features), seed=seed,
            )
        )
        frame = stages[-1].transform(frame)
    estimator = build_model(key, params, seed, n_train, n_features, label)
    if p.get("select_features") and stages:
        estimator = estimator.setFeaturesCol("_chosen")
    if key == "svm" and p.get("probability"):
        parts = train_test_split(frame, 0.2, id_col, seed, stratify=label)
        held_out = estimator.fit(parts.where("split = 'train'")).transform(parts.where("split = 'test'"))
        curve = LogisticRegression(
            featuresCol="rawPrediction", labelCol=label, predictionCol="_curve_label", rawPredictionCol="_curve_raw",
            probabilityCol="probability", standardization=False,
        )
        stages += [estimator.fit(frame), curve.fit(held_out.select("rawPrediction", label))]
    else:
        stages.append(estimator.fit(frame))
    return PipelineModel(stages)


def fit_many(jobs: Mapping[str, Any], threads: int = 4) -> dict[str, Any]:
    """Run independent fits from a few driver threads; each fit itself runs on the cluster."""
    if not jobs:
        return {}
    with ThreadPool(min(threads, len(jobs))) as pool:
        results = pool.map(lambda job: job(), list(jobs.values()))
    return dict(zip(jobs, results))


def score(df: DataFrame, model: Transformer, name: str | None = None) -> DataFrame:
    """Add ``pred`` (0/1) and ``proba`` (class 1), suffixed by ``name``; without probabilities the
    probability is the label itself."""
    suffix = f"_{name}" if name else ""
    out = model.transform(df)
    pred = F.col("prediction").cast("int")
    proba = vector_to_array("probability")[1] if "probability" in out.columns else pred.cast("double")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], pred.alias(f"pred{suffix}"), proba.alias(f"proba{suffix}"))


def decide(proba: Column | str, threshold: float = 0.5) -> Column:
    """1 iff the probability reaches the threshold."""
    p = F.col(proba) if isinstance(proba, str) else proba
    return F.when(p >= threshold, 1).otherwise(0)


def predict(df: DataFrame, model: PipelineModel, threshold: float | None = None) -> DataFrame:
    """``pred`` and ``proba`` from a fitted pipeline (which carries its vectorizer)."""
    out = score(df, model)
    return out if threshold is None else out.withColumn("pred", decide("proba", threshold))


def score_many(df: DataFrame, models: Mapping[str, Transformer]) -> DataFrame:
    """Predictions of several models side by side on one frame, without a join."""
    for name, model in models.items():
        df = score(df, model, name)
    return df


def known_models(keys: Sequence[str]) -> list[str]:
    """The keys that name a model; others are skipped."""
    return [k for k in keys if k in DEFAULT_PARAMS]
