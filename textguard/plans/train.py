"""Split, featurise, fit and evaluate every (embedding, model) route."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.metrics import classification_report
from textguard.operators.models import SEED, fit_many, fit_model, known_models, score
from textguard.operators.sampling import train_test_split
from textguard.operators.validate import apply_feature_engineering
from textguard.plans.featurise import fit_vectorizer
from textguard.sources.registry import save_model as store
from textguard.sources.writers import write_report


@dataclass
class TrainResult:
    report: DataFrame
    models: dict[str, PipelineModel]
    vectorizer: Transformer | None = None
    skipped: list[str] = field(default_factory=list)
    model_id: str | None = None

    def deployable(self, key: str) -> PipelineModel:
        """Vectorizer and classifier as one pipeline that scores raw text."""
        return PipelineModel([*([self.vectorizer] if self.vectorizer else []), self.models[key]])


def train_routes(
    features: DataFrame,
    embedding: str,
    model_keys: Sequence[str],
    params: Mapping[str, Mapping[str, Any]] | None = None,
    seed: int = SEED,
    label: str = "type",
) -> TrainResult:
    """Fit each model on ``split = 'train'`` and report on ``split = 'test'`` (one shared cache)."""
    keys = known_models(model_keys)
    frame = features.select("doc_id", label, "split", "features").persist()
    try:
        train = frame.where("split = 'train'")
        models = fit_many({k: (lambda k=k: fit_model(train, k, (params or {}).get(k), seed, label, cached=True)) for k in keys})
        report = None
        for key, model in models.items():
            scored = score(frame.where("split = 'test'"), model).select(F.lit(key).alias("model"), label, "pred")
            report = scored if report is None else report.unionByName(scored)
        if report is None:
            raise ValueError(f"no known model among {list(model_keys)}")
        # five rows per model leave the cluster, so the cache can be dropped
        rows = classification_report(report, label, "pred", by=["model"])
        out = features.sparkSession.createDataFrame(rows.collect(), rows.schema).withColumn("embedding", F.lit(embedding))
    finally:
        frame.unpersist()
    return TrainResult(out, models, skipped=[k for k in model_keys if k not in keys])


def train(
    corpus: DataFrame,
    embedding: str = "tfidf",
    model_keys: Sequence[str] = ("logistic_regression", "random_forest"),
    params: Mapping[str, Mapping[str, Any]] | None = None,
    test_size: float = 0.2,
    seed: int = SEED,
    fit_on: str = "train",
    max_features: int = 5000,
    stop_words="english",
    reports_root: str | None = None,
    registry_root: str | None = None,
    save_model: str | None = None,
    **embedding_options,
) -> TrainResult:
    """Cleaned corpus (doc_id, text, type) -> models and reports for one embedding.

    The vectorizer, whatever the method, sees the training part only; ``fit_on='all'`` lets it see the whole corpus. It is
    saved with the classifier, so the stored pipeline scores raw text. ``embedding_options`` are those of ``fit_vectorizer``.
    """
    if fit_on not in ("train", "all"):
        raise ValueError(f"fit_on is train or all, not {fit_on}")
    marked = train_test_split(corpus, test_size, seed=seed)
    seen = marked if fit_on == "all" else marked.where("split = 'train'")
    vectorizer = fit_vectorizer(seen, embedding, max_features=max_features, stop_words=stop_words, **embedding_options)
    features = vectorizer.transform(marked)
    result = train_routes(features, embedding, model_keys, params, seed)
    result.vectorizer = vectorizer
    if reports_root:
        for key in result.models:
            rows = result.report.where(F.col("model") == key).drop("model", "embedding")
            write_report(rows, reports_root, key, embedding)
    if save_model and registry_root and save_model in result.models:
        metrics = {r["row"]: r for r in result.report.where(F.col("model") == save_model).collect()}
        meta = {
            "embedding": embedding, "accuracy": metrics["accuracy"]["precision"], "precision": metrics["1"]["precision"],
            "recall": metrics["1"]["recall"], "f1": metrics["1"]["f1"], "test_size": test_size, "seed": seed,
        }
        result.model_id = store(
            corpus.sparkSession, result.deployable(save_model), registry_root, f"{save_model}_{embedding}", meta
        )
    return result


def quick_route(corpus: DataFrame, embedding: str = "tfidf", model_keys: Sequence[str] | None = None, **options) -> TrainResult:
    """No validation step: statistics and cleaning of the raw corpus, then every model."""
    from textguard.operators.models import MODEL_KEYS

    return train(apply_feature_engineering(corpus, "text"), embedding, model_keys or MODEL_KEYS, **options)
