"""The validation step and the feature-engineering step on a text column."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.operators.quality import dedup_keep_first, length_between, min_words

# The default validation settings.
DEFAULT_VALIDATION: dict[str, dict[str, Any]] = {
    "columns": {
        "text": "text",
        "label": "type",
        "text_aliases": ["content", "tweet", "message", "text"],
        "label_aliases": ["label", "target", "class"],
    },
    "validation": {
        "min_text_length": 3,
        "max_text_length": 10_000,
        "drop_duplicates": True,
        "drop_na_text": True,
    },
    "cleaning": {
        "lowercase": True,
        "remove_urls": True,
        "remove_mentions": True,
        "remove_hashtags": False,
        "remove_extra_whitespace": True,
        "fix_unicode": True,
    },
}

_CLEANING_FLAGS = (
    "fix_unicode",
    "remove_urls",
    "remove_mentions",
    "remove_hashtags",
    "lowercase",
    "remove_extra_whitespace",
)


def resolve_column(df: DataFrame, name: str, aliases: tuple[str, ...] | list[str] = ()) -> str | None:
    """``name`` if the frame has it, else its first alias, else ``None``."""
    return next((c for c in (name, *aliases) if c in df.columns), None)


def validate_and_preprocess(
    df: DataFrame, config: Mapping[str, Any] | None = None, id_col: str = "doc_id", dedup_clean: bool = False
) -> DataFrame:
    """Rename to ``text``/``type``, drop duplicates, drop null text, bound the length, clean lightly.

    ``None`` and ``{}`` mean the default settings; otherwise only the sections given apply.
    Duplicates are dropped on the raw text, so rows that become equal by cleaning survive unless
    ``dedup_clean`` is set. A missing label column is looked up among label aliases only.
    """
    cfg = dict(config) if config else DEFAULT_VALIDATION
    columns, checks, cleaning = (dict(cfg.get(k, {})) for k in ("columns", "validation", "cleaning"))
    defaults = DEFAULT_VALIDATION["columns"]
    text = resolve_column(df, columns.get("text", "text"), columns.get("text_aliases", defaults["text_aliases"]))
    label = resolve_column(df, columns.get("label", "type"), columns.get("label_aliases", defaults["label_aliases"]))
    out = df
    if text and text != "text":
        out = out.withColumnRenamed(text, "text")
    if label and label != "type":
        out = out.withColumnRenamed(label, "type")
    if checks.get("drop_duplicates", True):
        out = dedup_keep_first(out, "text", id_col) if "text" in out.columns else out.dropDuplicates()
    if "text" not in out.columns:
        return out
    out = out.withColumn("text", F.col("text").cast("string"))
    if checks.get("drop_na_text", True):
        out = out.dropna(subset=["text"])
    out = length_between(out, checks.get("min_text_length", 0), checks.get("max_text_length", 999_999))
    if cleaning:
        flags = {f: bool(cleaning[f]) for f in _CLEANING_FLAGS if f in cleaning}
        out = out.withColumn("text", T.clean_light("text", **flags))
        if dedup_clean:
            out = dedup_keep_first(out, "text", id_col)
    return out


def apply_feature_engineering(
    df: DataFrame, column: str = "text", more_than: int = 3, min_words_on: str = "raw", **clean_options: bool
) -> DataFrame:
    """Six statistics of the raw text, then aggressive cleaning, then the word-count filter.

    The filter looks at the raw word count (``min_words_on='clean'`` counts after cleaning).
    """
    # filter before computing anything: dropped rows need neither statistics nor cleaning
    out = min_words(df, column, more_than) if min_words_on == "raw" else df
    out = out.withColumns({f"{column}_{name}": fn(column) for name, fn in T.TEXT_STATS.items()})
    out = out.withColumn(column, T.clean_text(column, **clean_options))
    return out if min_words_on == "raw" else min_words(out, column, more_than)
