"""Stop-word lists are a parameter; the default is the English list bundled with Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def resolve_stop_words(stop_words: str | Sequence[str] | None) -> list[str]:
    """``None`` -> no list, a language name -> Spark's list for it, a sequence -> itself."""
    if stop_words is None:
        return []
    if isinstance(stop_words, str):
        from pyspark.ml.feature import StopWordsRemover

        return list(StopWordsRemover.loadDefaultStopWords(stop_words))
    return list(stop_words)


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """A list of one word per line, for corpora that need another library's list."""
    from textguard.session import bounded_collect

    words = spark.read.text(path).where("length(trim(value)) > 0")
    return [row["value"].strip() for row in bounded_collect(words, 100_000, "stop words")]
