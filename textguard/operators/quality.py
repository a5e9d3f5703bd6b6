"""Filters, deduplication, duplicate audits and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.errors import DatasetColumnMismatchError
from textguard.functions.hashing import text_digest
from textguard.functions.text import has_more_words, strip_spaces


# --- filters -----------------------------------------------------------------------------------


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(subset) if subset else None)


def min_length(df: DataFrame, column: str = "text", n: int = 5) -> DataFrame:
    return df.where(F.length(column) >= n)


def length_between(df: DataFrame, low: int = 3, high: int = 10_000, column: str = "text") -> DataFrame:
    """Bounds are on the text as it is, that is before any cleaning."""
    return df.where(F.length(column).between(low, high))


def min_words(df: DataFrame, column: str = "text", more_than: int = 3) -> DataFrame:
    """More than ``more_than`` words in the text as it is."""
    return df.where(has_more_words(column, more_than))


def search(
    df: DataFrame, pattern: str | None = None, label: int | None = None, text_col: str = "text", label_col: str = "type"
) -> DataFrame:
    """Label equality and a case-insensitive regular expression; null text never matches."""
    if label is not None:
        df = df.where(F.col(label_col) == label)
    if pattern:
        df = df.where(F.coalesce(F.col(text_col).rlike("(?i)" + pattern), F.lit(False)))
    return df


def isin_or_null(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    """Keep the chosen values and rows where the parameter was never set."""
    return df.where(F.col(column).isin(*values) | F.col(column).isNull())


def isin_all(df: DataFrame, choices: Mapping[str, Sequence[Any]]) -> DataFrame:
    for column, values in choices.items():
        df = df.where(F.col(column).isin(*values))
    return df


def match_metadata(df: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    """Exact match of every key; a key the frame does not have matches nothing but ``None``."""
    for key, value in wanted.items():
        column = F.col(key) if key in df.columns else F.lit(None)
        df = df.where(column.eqNullSafe(F.lit(value)))
    return df


def completed_trials(df: DataFrame) -> DataFrame:
    return df.where(F.col("state") == "COMPLETE")


# --- unions ------------------------------------------------------------------------------------


def merge_datasets(frames: Sequence[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Union of frames that must agree on columns and their order; no frames -> an empty frame."""
    if not frames:
        session = spark or SparkSession.getActiveSession()
        return session.createDataFrame([], "text string, type int")
    first = frames[0]
    for number, frame in enumerate(frames[1:], start=2):
        if frame.columns != first.columns:
            raise DatasetColumnMismatchError(f"dataset {number}: columns {frame.columns} != {first.columns}")
    merged = first
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


# --- duplicates --------------------------------------------------------------------------------


def dedup_keep_first(df: DataFrame, column: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Keep the row with the smallest id of each text; null texts count as one text.

    Only digests that occur more than once are joined back. Grouping combines on the map side, so
    a text that fills a third of the corpus reaches its reducer as one row per task; the join side
    holds repeated digests only, and adaptive execution broadcasts it or splits the hot key. A frame
    without ``id_col`` is taken in scan order (it must come straight from a scan).
    """
    if id_col not in df.columns:
        return dedup_keep_first(df.withColumn(id_col, F.monotonically_increasing_id()), column, id_col).drop(id_col)
    digest = F.coalesce(text_digest(column), F.unhex(F.lit("00")))
    repeated = (
        df.groupBy(digest.alias("_digest"))
        .agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    return (
        df.withColumn("_digest", digest)
        .join(repeated, "_digest", "left")
        .where(F.col("_first").isNull() | (F.col(id_col) == F.col("_first")))
        .drop("_digest", "_first")
    )


def duplicate_report(df: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per source: total, unique_texts, dup_texts, dup_rows (all members), null_texts, pct_dup, status.

    Null texts are reported in a column of their own and otherwise act as one text.
    """
    groups = df.groupBy(source_col, text_digest(strip_spaces(text_col)).alias("_digest")).agg(
        F.count("*").alias("_n")
    )
    totals = groups.groupBy(source_col).agg(
        F.sum("_n").alias("total"),
        F.count("*").alias("unique_texts"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("dup_rows"),
        F.sum(F.when(F.col("_digest").isNull(), F.col("_n")).otherwise(0)).alias("null_texts"),
    )
    pct = F.lit(100.0) * (F.col("total") - F.col("unique_texts")) / F.col("total")
    return totals.select(
        source_col,
        "total",
        "unique_texts",
        (F.col("total") - F.col("unique_texts")).alias("dup_texts"),
        "dup_rows",
        "null_texts",
        pct.alias("pct_dup"),
        F.when(pct < 1, "OK").otherwise("DUPLICATES").alias("status"),
    )


def duplicated_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row whose trimmed text occurs more than once."""
    digest = text_digest(strip_spaces(text_col))
    repeated = (
        df.select(digest.alias("_digest")).groupBy("_digest").count().where("count > 1").select("_digest")
    )
    return df.withColumn("_digest", digest).join(repeated, "_digest", "left_semi").drop("_digest")


def text_overlap(train: DataFrame, test: DataFrame, train_col: str = "text", test_col: str = "text") -> DataFrame:
    """Distinct trimmed texts of both frames, how many they share, and the share of the test texts."""
    both = (
        train.select(text_digest(strip_spaces(train_col)).alias("d"), F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(
            test.select(text_digest(strip_spaces(test_col)).alias("d"), F.lit(0).alias("a"), F.lit(1).alias("b"))
        )
        .groupBy("d")
        .agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    counts = both.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("train_texts"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("test_texts"),
        F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("overlap"),
    )
    return counts.withColumn("pct_of_test", F.try_divide(F.lit(100.0) * F.col("overlap"), F.col("test_texts")))
