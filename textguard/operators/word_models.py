"""Fitted text vectorizers that are saved and loaded with their classifier.

A word-vector model keeps its words in a parquet table beside the metadata and joins (or, if small,
looks up) them when it transforms; an encoder model keeps the import path and arguments of its factory.
Both are ordinary pipeline stages: ``PipelineModel.save`` and ``load`` carry them.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from textguard.errors import UnknownMethodError
from textguard.operators.aggregate_vectors import METHODS as AGGREGATIONS
from textguard.operators.aggregate_vectors import document_vectors
from textguard.operators.cbow import train_cbow
from textguard.operators.cooccurrence import cooccurrence, train_glove
from textguard.operators.vectorize import embed_batch


class WordVectorModel(Model, MLReadable, MLWritable):
    """Document vectors from a fitted table ``words`` (word, vector)."""

    text_col = Param(Params._dummy(), "text_col", "text column", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "vector column", TypeConverters.toString)
    aggregation = Param(Params._dummy(), "aggregation", "how the vectors of a text's words combine", TypeConverters.toString)

    def __init__(self, words: DataFrame | None = None, text_col: str = "text", output: str = "features", aggregation: str = "mean"):
        super().__init__()
        if aggregation not in AGGREGATIONS:
            raise UnknownMethodError(f"unknown aggregation {aggregation}")
        self.words = words
        self._set(text_col=text_col, output=output, aggregation=aggregation)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.getOrDefault(self.output)
        out = document_vectors(dataset, self.words, self.getOrDefault(self.aggregation), self.getOrDefault(self.text_col), output="_v")
        return out.withColumn(name, array_to_vector("_v")).drop("_v")

    def write(self) -> MLWriter:
        return _WordVectorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _WordVectorReader(cls)


class _WordVectorWriter(MLWriter):
    def __init__(self, instance: WordVectorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.words.select("word", "vector").write.parquet(f"{path}/words")


class _WordVectorReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> WordVectorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(self.sparkSession.read.parquet(f"{path}/words"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class WordVectorizer(Estimator):
    """Learns word vectors (``word2vec`` or ``glove``) of the frame it is fitted on."""

    def __init__(self, method: str, text_col: str = "text", output: str = "features", aggregation: str = "mean", vector_size: int = 100, stop_words="english", **training):
        super().__init__()
        if method not in ("word2vec", "glove"):
            raise UnknownMethodError(method)
        self.method, self.text_col, self.output, self.aggregation = method, text_col, output, aggregation
        self.vector_size, self.stop_words, self.training = vector_size, stop_words, training

    def _fit(self, dataset: DataFrame) -> WordVectorModel:
        if self.method == "word2vec":
            words = train_cbow(dataset, self.text_col, self.vector_size, **self.training)
        else:
            words = train_glove(cooccurrence(dataset, self.text_col, stop_words=self.stop_words), self.vector_size, **self.training)
        return WordVectorModel(words, self.text_col, self.output, self.aggregation)


def factory_path(factory: Callable) -> str:
    """``module:name`` of a factory that another process can import, or an empty string."""
    name = getattr(factory, "__qualname__", "")
    if not name or "<" in name or "." in name or factory.__module__ == "__main__":
        return ""
    return f"{factory.__module__}:{name}"


class EncoderModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Vectors from a sentence encoder. ``factory(**arguments)`` returns a maker of predict functions; it is
    imported by path where the model is loaded. Arguments are JSON values."""

    factory = Param(Params._dummy(), "factory", "module:name of the factory", TypeConverters.toString)
    arguments = Param(Params._dummy(), "arguments", "arguments of the factory as JSON", TypeConverters.toString)
    text_col = Param(Params._dummy(), "text_col", "text column", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, factory="", arguments="{}", text_col="text", output="features"):
        super().__init__()
        self._setDefault(factory="", arguments="{}", text_col="text", output="features")
        self._set(**self._input_kwargs)
        self.maker: Callable | None = None

    @classmethod
    def of(cls, encoder: Callable, arguments: dict | None = None, text_col: str = "text", output: str = "features") -> EncoderModel:
        """With ``arguments`` the encoder is a factory of makers and can be saved if it is importable; without, it is the maker itself."""
        path = factory_path(encoder) if arguments is not None else ""
        model = cls(factory=path, arguments=json.dumps(arguments or {}, sort_keys=True), text_col=text_col, output=output)
        model.maker = encoder(**arguments) if arguments is not None else encoder
        return model

    def _make(self) -> Callable:
        if self.maker is None:
            module, _, name = self.getOrDefault(self.factory).partition(":")
            self.maker = getattr(importlib.import_module(module), name)(**json.loads(self.getOrDefault(self.arguments)))
        return self.maker

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = embed_batch(dataset, self._make(), self.getOrDefault(self.text_col), "_v")
        return out.withColumn(self.getOrDefault(self.output), array_to_vector("_v")).drop("_v")

    def write(self) -> MLWriter:
        if not self.getOrDefault(self.factory):
            raise ValueError("an encoder is saved by the import path of its factory: give a top-level factory and encoder_args")
        return super().write()
