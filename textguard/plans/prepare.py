"""Raw sources -> one validated corpus, audits and recaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators.quality import duplicate_report, text_overlap
from textguard.operators.reports import pivot_metric
from textguard.operators.validate import validate_and_preprocess
from textguard.sources.readers import read_many, read_raw, read_reports
from textguard.sources.schema import audit_text_column


def prepare(
    spark: SparkSession, paths: Sequence[str], n_samples: int | None = None, config: Mapping[str, Any] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(validated corpus, sources that were skipped)."""
    corpus, errors = read_many(spark, paths, n_samples)
    return validate_and_preprocess(corpus, config), errors


def duplicate_audit(
    spark: SparkSession, paths: Sequence[str], overlap: tuple[str, str] | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Duplicate report over files and, for a (train, test) pair of paths, their overlap."""
    out = None
    for path in paths:
        raw = read_raw(spark, path)
        part = raw.select(F.lit(path.rsplit("/", 1)[-1]).alias("source"), F.col(audit_text_column(raw)).cast("string").alias("text"))
        out = part if out is None else out.unionByName(part)
    shared = None
    if overlap:
        left, right = (read_raw(spark, p) for p in overlap)
        shared = text_overlap(left, right, audit_text_column(left), audit_text_column(right))
    return duplicate_report(out), shared


def recap(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(one row per report file, model x embedding table of F1)."""
    rows = read_reports(spark, glob)
    return rows.orderBy("embedding", F.desc("f1"), "model"), pivot_metric(rows)
