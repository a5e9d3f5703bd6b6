"""Voting, stacking and cross-validated comparison."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.metrics import binary_metrics, cv_summary
from textguard.operators.models import SEED, fit_many, fit_model, score, score_many
from textguard.operators.sampling import assign_folds


def soft_vote(probas: Sequence[str]) -> tuple[Column, Column]:
    """(label, probability): mean probability; an exact tie goes to class 0."""
    mean = sum((F.col(c) for c in probas[1:]), F.col(probas[0])) / len(probas)
    return (mean > 0.5).cast("int"), mean


def hard_vote(preds: Sequence[str]) -> Column:
    """Majority label; a tie goes to the lower label."""
    votes = sum((F.col(c) for c in preds[1:]), F.col(preds[0]))
    return (votes * 2 > len(preds)).cast("int")


def one_hot_proba(proba: Column | None, pred: Column) -> Column:
    """[P(0), P(1)]; where no probability exists the prediction itself, one-hot."""
    hard = F.array(1.0 - pred.cast("double"), pred.cast("double"))
    return hard if proba is None else F.when(proba.isNull(), hard).otherwise(F.array(1.0 - proba, proba))


def combine_routes(routes: Mapping[str, DataFrame], voting: str = "soft", id_col: str = "doc_id") -> DataFrame:
    """Vote over predictions of different embeddings, matched by id.

    Each route brings (id, pred, proba). One union and two groupings, whatever the number of routes; only ids
    present in every route get a vote. An id that a route holds more than once has the mean probability and the
    more frequent label there (1 if equally frequent), so every route has one vote.
    """
    out = None
    for number, frame in enumerate(routes.values()):
        part = frame.select(id_col, "pred", "proba", F.lit(number).alias("_route"))
        out = part if out is None else out.unionByName(part)
    out = out.groupBy(id_col, "_route").agg((F.avg("pred") >= 0.5).cast("int").alias("pred"), F.avg("proba").alias("proba"))
    votes = out.groupBy(id_col).agg(
        F.count("*").alias("_n"), F.collect_set("_route").alias("_routes"), F.sum("pred").alias("_votes"), F.avg("proba").alias("proba")
    ).where(F.size("_routes") == len(routes))
    pred = F.col("proba") > 0.5 if voting == "soft" else F.col("_votes") * 2 > F.col("_n")
    return votes.select(id_col, pred.cast("int").alias("pred"), "proba")


@dataclass
class VotingModel:
    members: dict[str, PipelineModel]
    voting: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Add pred and proba (soft: mean probability, hard: share of votes) plus the members' own."""
        out = score_many(df, self.members)
        preds = [f"pred_{m}" for m in self.members]
        if self.voting == "soft":
            pred, proba = soft_vote([f"proba_{m}" for m in self.members])
        else:
            pred, proba = hard_vote(preds), sum((F.col(c) for c in preds[1:]), F.col(preds[0])) / len(preds)
        return out.withColumns({"pred": pred, "proba": proba})


def has_probability(model: Transformer, sample: DataFrame) -> bool:
    return "probability" in model.transform(sample.limit(0)).columns


def fit_voting(
    train: DataFrame,
    members: Mapping[str, Mapping[str, Any]] | None = None,
    voting: str = "soft",
    fitted: Mapping[str, PipelineModel] | None = None,
    seed: int = SEED,
) -> VotingModel:
    """Voting over newly fitted ``members`` ({key: parameters}) and/or already ``fitted`` models.

    Soft voting falls back to hard voting, with a warning, if a member gives no probabilities.
    """
    if voting not in ("soft", "hard"):
        raise ValueError("voting must be soft or hard")
    frame = train.persist()
    jobs = {k: (lambda k=k, p=p: fit_model(frame, k, p, seed, cached=True)) for k, p in (members or {}).items()}
    try:
        models = {**(fitted or {}), **fit_many(jobs)}
    finally:
        frame.unpersist()
    if voting == "soft" and not all(has_probability(m, train) for m in models.values()):
        warnings.warn("a member has no probabilities: hard voting is used", stacklevel=2)
        voting = "hard"
    return VotingModel(models, voting)


@dataclass
class StackingModel:
    members: dict[str, PipelineModel]
    assembler: VectorAssembler
    meta: Transformer

    def transform(self, df: DataFrame) -> DataFrame:
        meta_in = self.assembler.transform(score_many(df, self.members))
        return score(meta_in, self.meta).drop("_meta")


def out_of_fold(
    folded: DataFrame, members: Mapping[str, Mapping[str, Any]], k: int, seed: int = SEED
) -> DataFrame:
    """Probabilities of each row from models that did not see its fold."""
    jobs = {
        (m, f): (lambda m=m, f=f: fit_model(folded.where(F.col("fold") != f), m, members[m], seed, cached=True))
        for m in members
        for f in range(k)
    }
    fitted = fit_many(jobs)
    out = None
    for f in range(k):
        part = score_many(folded.where(F.col("fold") == f), {m: fitted[(m, f)] for m in members})
        out = part if out is None else out.unionByName(part)
    return out


def fit_stacking(
    train: DataFrame,
    members: Mapping[str, Mapping[str, Any]],
    k: int = 5,
    label: str = "type",
    id_col: str = "doc_id",
    seed: int = SEED,
    meta: Any = None,
) -> StackingModel:
    """Meta model on out-of-fold probabilities; the members are refitted on all rows."""
    folded = assign_folds(train, k, label, id_col, seed).persist()
    try:
        scored = out_of_fold(folded, members, k, seed)
        assembler = VectorAssembler(inputCols=[f"proba_{m}" for m in members], outputCol="_meta")
        meta = meta or LogisticRegression(maxIter=1000, standardization=False, regParam=1.0 / max(folded.count(), 1))
        meta_model = meta.copy({meta.featuresCol: "_meta", meta.labelCol: label}).fit(
            assembler.transform(scored).select("_meta", label)
        )
        final = fit_many({m: (lambda m=m: fit_model(folded, m, members[m], seed, cached=True)) for m in members})
    finally:
        folded.unpersist()
    return StackingModel(final, assembler, meta_model)


def fold_scores(
    df: DataFrame,
    members: Mapping[str, tuple[str, Mapping[str, Any]]],
    k: int = 5,
    label: str = "type",
    id_col: str = "doc_id",
    seed: int = SEED,
) -> DataFrame:
    """(model, fold, n, accuracy, precision, recall, f1) for ``{name: (key, parameters)}``."""
    folded = assign_folds(df, k, label, id_col, seed).persist()
    try:
        return folded_scores(folded, members, k, label, seed)
    finally:
        folded.unpersist()


def folded_scores(
    folded: DataFrame, members: Mapping[str, tuple[str, Mapping[str, Any]]], k: int = 5, label: str = "type", seed: int = SEED
) -> DataFrame:
    """:func:`fold_scores` of a frame that has its folds already; the caller keeps it cached."""
    jobs = {
        (name, f): (lambda key=key, p=p, f=f: fit_model(folded.where(F.col("fold") != f), key, p, seed, cached=True))
        for name, (key, p) in members.items()
        for f in range(k)
    }
    fitted = fit_many(jobs)
    out = None
    for (name, f), model in fitted.items():
        part = score(folded.where(F.col("fold") == f), model).select(
            F.lit(name).alias("model"), F.lit(f).alias("fold"), label, "pred"
        )
        out = part if out is None else out.unionByName(part)
    # k scores per model are all that leaves the cluster
    rows = binary_metrics(out, label, "pred", by=["model", "fold"]).collect()
    return folded.sparkSession.createDataFrame(
        rows, "model string, fold int, n long, accuracy double, precision double, recall double, f1 double"
    )


def compare_models(df: DataFrame, members: Mapping[str, Mapping[str, Any]], k: int = 5, **options) -> DataFrame:
    """Mean, deviation, min and max of the cross-validated F1 per model, best first."""
    return cv_summary(fold_scores(df, {m: (m, p) for m, p in members.items()}, k, **options))


def evaluate_ensemble(model: VotingModel | StackingModel, test: DataFrame, label: str = "type") -> DataFrame:
    return binary_metrics(model.transform(test), label, "pred")
