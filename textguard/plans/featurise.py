"""Texts -> feature column by one of six methods, optionally cached."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from textguard.errors import UnknownMethodError
from textguard.operators.validate import apply_feature_engineering
from textguard.operators.vectorize import TextVectorizer
from textguard.operators.word_models import EncoderModel, WordVectorizer, WordVectorModel
from textguard.sources.readers import read_word_vectors
from textguard.sources.writers import cached_embedding, write_processed

METHODS = ("tfidf", "bow", "word2vec", "glove", "bert", "roberta")


def fit_vectorizer(
    df: DataFrame,
    method: str,
    text_col: str = "text",
    output: str = "features",
    max_features: int = 5000,
    ngram: tuple[int, int] = (1, 2),
    glove_path: str | None = None,
    vector_size: int = 100,
    aggregation: str = "mean",
    retrain: bool = False,
    encoder: Callable | None = None,
    encoder_args: dict | None = None,
    stop_words="english",
    training: dict | None = None,
) -> Transformer:
    """The fitted stage of a method, learned from ``df`` only: it transforms any text and is saved with a pipeline.

    Word vectors come from ``glove_path`` where it is given and ``retrain`` is not. ``bert`` and ``roberta``
    need an ``encoder``: a maker of predict functions, or with ``encoder_args`` a top-level factory of such makers,
    which can also be saved. ``training`` holds further arguments of the word-vector training.
    """
    if method not in METHODS:
        raise UnknownMethodError(f"unknown method {method}")
    if method in ("tfidf", "bow"):
        return TextVectorizer(method, text_col, output, max_features, ngram, stop_words).fit(df)
    if method == "glove" and glove_path and not retrain:
        return WordVectorModel(read_word_vectors(df.sparkSession, glove_path), text_col, output, aggregation)
    if method in ("word2vec", "glove"):
        return WordVectorizer(method, text_col, output, aggregation, vector_size, stop_words, **(training or {})).fit(df)
    if encoder is None:
        raise ValueError(f"{method} needs an encoder")
    return EncoderModel.of(encoder, encoder_args, text_col, output)


def embed(
    df: DataFrame,
    method: str,
    text_col: str = "text",
    output: str = "features",
    cache_root: str | None = None,
    encoder_key: str | None = None,
    retrain: bool = False,
    **options,
) -> DataFrame:
    """Add a vector column ``output`` fitted on ``df`` itself; ``options`` are those of :func:`fit_vectorizer`. A cached
    encoder needs an ``encoder_key`` that names the model and all its settings."""
    if method not in METHODS:
        raise UnknownMethodError(f"unknown method {method}")
    encoder = options.get("encoder")

    def build(frame: DataFrame) -> DataFrame:
        return fit_vectorizer(frame, method, text_col, output, retrain=retrain, **options).transform(frame)

    if cache_root is None:
        return build(df)
    if encoder is not None and encoder_key is None:
        raise ValueError("a cached encoder needs an encoder_key")
    params: dict[str, Any] = {k: v for k, v in options.items() if k != "encoder"}
    params |= {"encoder": encoder_key, "text_col": text_col, "output": output}
    return cached_embedding(df, method, params, build, cache_root, text_col, retrain=retrain)


def featurise(df: DataFrame, embedding: str, root: str | None = None, **options) -> DataFrame:
    """Statistics and cleaning, then the feature column; written as one partition if ``root`` is given."""
    out = embed(apply_feature_engineering(df, "text"), embedding, **options)
    if root is not None:
        write_processed(out, root, embedding)
    return out
