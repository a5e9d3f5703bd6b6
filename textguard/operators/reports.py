"""Report, run and registry tables: parsing, summaries, rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.ordered import Running, running
from textguard.operators.quality import isin_or_null, match_metadata

METRICS = ("accuracy", "precision", "recall", "f1")
EMBEDDINGS = ("tfidf", "bow", "word2vec", "glove", "bert", "roberta")
# Anchored, so that a roberta report is never taken for a bert one and the model keeps its full name.
REPORT_NAME = r"^(.*)_(" + "|".join(EMBEDDINGS) + r")_report(?:\.csv)?$"


def report_name_columns(file_name: Column | str) -> tuple[Column, Column]:
    """(model, embedding) from ``{model}_{embedding}_report.csv``; names of another form give
    the name itself and ``unknown``."""
    c = F.col(file_name) if isinstance(file_name, str) else file_name
    matched = c.rlike(REPORT_NAME)
    model = F.when(matched, F.regexp_extract(c, REPORT_NAME, 1)).otherwise(F.regexp_replace(c, r"_report(\.csv)?$", ""))
    embedding = F.when(matched, F.regexp_extract(c, REPORT_NAME, 2)).otherwise(F.lit("unknown"))
    return model.alias("model"), embedding.alias("embedding")


def recap_reports(reports: DataFrame, file_col: str = "file_name", missing: float | None = 0.0) -> DataFrame:
    """Long report rows -> one recap row per file.

    Accuracy is the precision cell of the accuracy row; class 1 is the first row whose name holds
    a "1"; what is missing becomes ``missing`` (0, or NaN/None for the session view).
    """
    positive = F.col("row").contains("1")
    first_one = F.min_by(F.struct("precision", "recall", "f1"), F.when(positive, F.col("row")))
    per_file = reports.groupBy(file_col).agg(
        F.max(F.when(F.col("row") == "accuracy", F.col("precision"))).alias("accuracy"), first_one.alias("one")
    )
    fill = F.lit(missing).cast("double")
    return per_file.select(
        *report_name_columns(file_col),
        F.coalesce("accuracy", fill).alias("accuracy"),
        *[F.coalesce(F.col("one")[m], fill).alias(m) for m in ("precision", "recall", "f1")],
    )


def dataset_summary(tests: DataFrame, seq: str = "seq", digits: int = 3) -> DataFrame:
    """Per dataset: mean, max and min of accuracy and f1, and the samples of its first test."""
    aggs = []
    for metric in ("accuracy", "f1"):
        for name, fn in (("mean", F.avg), ("max", F.max), ("min", F.min)):
            aggs.append(F.round(fn(metric), digits).alias(f"{metric}_{name}"))
    return tests.groupBy("dataset").agg(*aggs, F.min_by("samples", seq).alias("samples_first"))


def mean_by_route(runs: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ("embedding", "model")) -> DataFrame:
    return runs.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics if m in runs.columns])


def pivot_metric(runs: DataFrame, metric: str = "f1", embeddings: Sequence[str] = EMBEDDINGS) -> DataFrame:
    """Model x embedding means; the column values are given, so no extra pass looks for them."""
    return runs.groupBy("model").pivot("embedding", list(embeddings)).agg(F.avg(metric))


def filter_runs(runs: DataFrame, choices: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Runs whose parameter is among the chosen values or was never logged."""
    for column, values in choices.items():
        runs = isin_or_null(runs, column, values)
    return runs


def run_duration(runs: DataFrame) -> DataFrame:
    """Seconds between start and end where no duration was logged."""
    computed = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / F.lit(1e6)
    known = F.coalesce("duration", computed) if "duration" in runs.columns else computed
    return runs.withColumn("duration", known)


def latest_runs(runs: DataFrame, n: int = 50, tie: str = "run_id") -> DataFrame:
    """The ``n`` newest runs (a top-k report: sorted and limited, never fully sorted)."""
    return runs.orderBy(F.desc("start_time"), tie).limit(n)


def list_models(registry: DataFrame, filter_by: Mapping[str, Any] | None = None) -> DataFrame:
    """Registry rows with defaults for missing entries, newest first."""
    rows = match_metadata(registry, filter_by or {})
    text = [F.coalesce(F.col(c), F.lit("Unknown")).alias(c) if c in rows.columns else F.lit("Unknown").alias(c)
            for c in ("name", "embedding", "dataset", "timestamp")]
    nums = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in rows.columns else F.lit(0.0).alias(c)
            for c in ("accuracy", "f1")]
    return rows.select("model_id", *text, *nums).orderBy(F.desc("timestamp"), "model_id")


def best_model(registry: DataFrame, metric: str = "f1", filter_by: Mapping[str, Any] | None = None) -> DataFrame:
    """The row with the highest metric; among equals the newest."""
    rows = list_models(registry, filter_by)
    if metric not in rows.columns:
        raise ValueError(f"metric {metric} is not available")
    return rows.orderBy(F.desc(metric), F.desc("timestamp"), "model_id").limit(1)


def rank_by(df: DataFrame, metric: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(metric), *ties)


def melt_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    return df.unpivot(list(ids), list(metrics), "metric", "score")


def metric_evolution(
    tests: DataFrame, metric: str, time_col: str = "start_time", tie: str = "run_id", keys: Sequence[str] = ()
) -> DataFrame:
    """Test number (from 0) and best value so far in time order (see :mod:`textguard.operators.ordered`)."""
    values = {"test_number": Running(F.lit(1).cast("long"), "sum", inclusive=False), f"best_{metric}": Running(F.col(metric), "max")}
    return running(tests, values, [time_col, tie], keys)


def top_words(explanations: DataFrame, k: int = 10, positive: str = "Cyberbullying", negative: str = "Normal") -> DataFrame:
    """The ``k`` words of largest absolute impact with the class they speak for."""
    return (
        explanations.withColumn("impact", F.abs("weight"))
        .withColumn("direction", F.when(F.col("weight") > 0, positive).otherwise(negative))
        .orderBy(F.desc("impact"), "word")
        .limit(k)
    )
