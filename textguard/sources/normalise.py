"""Public corpora of known shapes -> (text, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.quality import min_length
from textguard.sources import schema as S


def normalise_auto(df: DataFrame) -> DataFrame:
    """``text``/``label`` by name with automatic labels, else guessed columns and ``!= 0``.

    Nothing recognisable gives an empty frame.
    """
    if {"text", "label"} <= set(df.columns):
        return df.select(F.col("text").cast("string").alias("text"), S.to_binary_auto(df, "label").alias("type"))
    guess = S.guess_columns(df)
    if guess is None:
        return df.sparkSession.createDataFrame([], "text string, type int")
    text, label = guess
    return df.select(F.col(text).alias("text"), S.to_binary_not(label, 0).alias("type"))


def normalise_named(df: DataFrame, text_col: str = "text", label_col: str = "label", negative: object = 0) -> DataFrame:
    """Rename and compare the label with one negative value (``None`` casts it)."""
    if text_col not in df.columns or label_col not in df.columns:
        raise S.ColumnNotFoundError(f"columns {text_col}, {label_col} expected")
    label = S.to_binary(label_col) if negative is None else S.to_binary_not(label_col, negative)
    return df.select(F.col(text_col).cast("string").alias("text"), label.alias("type"))


def normalise_annotated(
    df: DataFrame, tokens_col: str = "post_tokens", votes: str = "annotators.label", negative: int = 2
) -> DataFrame:
    """Token lists joined by spaces and the majority of the annotators' labels."""
    return df.select(
        F.array_join(tokens_col, " ").alias("text"), S.majority_label(F.col(votes), negative).alias("type")
    )


SHAPES = {
    "auto": normalise_auto,
    "sarcasm": lambda df: normalise_named(df, "text", "label", 0),
    "comments": lambda df: normalise_named(df, "comment_text", "label", 0),
    "annotated": normalise_annotated,
}


def normalise_sources(sources: dict[str, tuple[str, dict[str, DataFrame]]]) -> DataFrame:
    """``{source: (shape, {split: frame})}`` -> one corpus (source, split, text, type).

    Texts shorter than 5 characters are dropped.
    """
    out = None
    for source, (shape, splits) in sources.items():
        for split, frame in splits.items():
            part = min_length(SHAPES[shape](frame)).select(
                F.lit(source).alias("source"), F.lit(split).alias("split"), "text", "type"
            )
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source selected")
    return out
