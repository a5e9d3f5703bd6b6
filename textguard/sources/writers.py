"""Feature tables, report tables, normalised corpora and the embedding cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_processed(df: DataFrame, root: str, embedding: str) -> None:
    """Replace the partition of one embedding and leave the others alone."""
    (
        df.withColumn("embedding", F.lit(embedding))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("embedding")
        .parquet(root)
    )


def write_report(report: DataFrame, root: str, model: str, embedding: str) -> None:
    """Replace the report of one (model, embedding) in the partitioned report table."""
    (
        report.withColumns({"model": F.lit(model), "embedding": F.lit(embedding)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "embedding")
        .parquet(root)
    )


def write_report_csv(report: DataFrame, root: str, model: str, embedding: str) -> str:
    """One report (five rows) as CSV under ``{model}_{embedding}_report.csv`` for other tools."""
    path = f"{root}/{model}_{embedding}_report.csv"
    (
        report.select(F.col("row").alias(" "), "precision", "recall", F.col("f1").alias("f1-score"), "support")
        .coalesce(1)
        .write.mode("overwrite")
        .csv(path, header=True)
    )
    return path


def write_normalised(df: DataFrame, root: str) -> None:
    """Unified corpus by source and split; reading ``root`` without a filter is the union."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "split")
        .parquet(root)
    )


def corpus_fingerprint(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Order-independent digest of a corpus in one pass: rows, sum and xor of per-row md5 prefixes."""
    row = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col(text_col)))
    value = F.conv(F.substring(row, 1, 8), 16, 10).cast("long")
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(value), F.lit(0)).alias("digest_sum"),
        F.coalesce(F.bit_xor(value), F.lit(0)).alias("digest_xor"),
    )


def cached_embedding(
    df: DataFrame,
    method: str,
    params: dict,
    build: Callable[[DataFrame], DataFrame],
    root: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    retrain: bool = False,
) -> DataFrame:
    """``build(df)`` stored under a key of all columns of ``df``, method and all parameters; reused when present.

    The stored frame has the caller's columns, so rows with the same texts and another label or split
    have another key. Retraining bypasses the cache; an unreadable entry is recomputed.
    """
    if retrain:
        return build(df)
    mark = corpus_fingerprint(df, text_col, id_col).first()
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    whole = df.agg(F.sum(row.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(row).alias("parity")).first()
    key = json.dumps(
        [mark["rows"], mark["digest_sum"], mark["digest_xor"], df.schema.simpleString(), whole["total"], whole["parity"], method, params],
        sort_keys=True, default=str,
    )
    path = f"{root}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    spark = df.sparkSession
    try:
        cached = spark.read.parquet(path)
        cached.isEmpty()
        return cached
    except (AnalysisException, PySparkException, Py4JJavaError):
        build(df).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
