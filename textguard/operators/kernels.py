"""Explicit feature maps for kernel machines, so that a linear solver scales to any row count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def fourier_weights(dims: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection and phases of random Fourier features for ``exp(-gamma |x - y|^2)``."""
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2 * gamma), size=(dims, size)), rng.uniform(0, 2 * np.pi, size)


def sketch_hashes(dims: int, size: int, degree: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, size, (degree, dims)), rng.choice([-1.0, 1.0], (degree, dims))


def fourier_features(index: np.ndarray, value: np.ndarray, weights: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / weights.shape[1]) * np.cos(value @ weights[index] + phase)


def polynomial_sketch(
    index: np.ndarray, value: np.ndarray, bucket: np.ndarray, sign: np.ndarray, size: int, gamma: float
) -> np.ndarray:
    """TensorSketch of ``(gamma <x, y>) ** degree``: product of count sketches in Fourier space."""
    product = np.ones(size // 2 + 1, dtype=complex)
    for h, s in zip(bucket, sign):
        product *= np.fft.rfft(np.bincount(h[index], weights=np.sqrt(gamma) * s[index] * value, minlength=size))
    return np.fft.irfft(product, n=size)


class KernelFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``kind`` rbf or poly. Random weights follow from the seed, so nothing is broadcast or stored."""

    kind = Param(Params._dummy(), "kind", "rbf or poly", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "output dimensions", TypeConverters.toInt)
    dims = Param(Params._dummy(), "dims", "input dimensions", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "polynomial degree", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the weights", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="_mapped", kind="rbf", size=512, dims=1, gamma=1.0, degree=3, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="_mapped", kind="rbf", size=512, dims=1, gamma=1.0, degree=3, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kind, size, dims = (self.getOrDefault(p) for p in (self.kind, self.size, self.dims))
        gamma, degree, seed = (self.getOrDefault(p) for p in (self.gamma, self.degree, self.seed))

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            if kind == "rbf":
                weights, phase = fourier_weights(dims, size, gamma, seed)
            else:
                bucket, sign = sketch_hashes(dims, size, degree, seed)
            for indices, values in batches:
                out = []
                for index, value in zip(indices, values):
                    index = np.arange(dims) if index is None else np.asarray(index)
                    if kind == "rbf":
                        out.append(fourier_features(index, np.asarray(value), weights, phase))
                    else:
                        out.append(polynomial_sketch(index, np.asarray(value), bucket, sign, size, gamma))
                yield pd.Series(out)

        mapped = F.pandas_udf(run, ArrayType(DoubleType()))
        parts = F.unwrap_udt(self.getInputCol())
        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(parts["indices"], parts["values"])))
