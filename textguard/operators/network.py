"""Rectifier network for two classes: minibatch Adam on the executors, averaged between rounds.

In a round every task passes a few times over its own rows in minibatches, starting from the common weights and
moments; the results are averaged by rows, in pieces that are summed on the map side. One task's worth of
rows is plain minibatch training. What reaches the driver is the network, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALLEST_BATCH = 8
# The usual settings of the optimiser.
BATCH, RATE, BETA1, BETA2, TINY, PENALTY = 200, 1e-3, 0.9, 0.999, 1e-8, 1e-4
ROUND_PASSES = 10
PIECE = 4096


def shapes(sizes: Sequence[int]) -> list[tuple[int, int]]:
    """Weights and intercepts of every layer, intercepts as a last row."""
    return [(a + 1, b) for a, b in zip(sizes, sizes[1:])]


def unpack(flat: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    ends = np.cumsum([a * b for a, b in shapes(sizes)])
    return [flat[e - a * b : e].reshape(a, b) for e, (a, b) in zip(ends, shapes(sizes))]


def start_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6.0 / (a - 1 + b)) for a, b in shapes(sizes)])


def margins(x: np.ndarray, layers: Sequence[np.ndarray]) -> np.ndarray:
    for k, w in enumerate(layers):
        x = x @ w[:-1] + w[-1]
        if k < len(layers) - 1:
            x = np.maximum(x, 0)
    return x[:, 0]


def gradient(x: np.ndarray, y: np.ndarray, flat: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Of the mean logistic loss and the squared-weight penalty."""
    layers, inputs = unpack(flat, sizes), [x]
    for k, w in enumerate(layers):
        x = inputs[-1] @ w[:-1] + w[-1]
        inputs.append(np.maximum(x, 0) if k < len(layers) - 1 else x)
    back = (1 / (1 + np.exp(-np.clip(inputs[-1], -30, 30))) - y[:, None]) / len(y)
    out = []
    for k in range(len(layers) - 1, -1, -1):
        grad = np.vstack([inputs[k].T @ back, back.sum(0)])
        grad[:-1] += PENALTY / len(y) * layers[k][:-1]
        out.append(grad.ravel())
        if k:
            back = back @ layers[k][:-1].T * (inputs[k] > 0)
    return np.concatenate(out[::-1])


def dense(indices: Sequence, values: Sequence, width: int) -> np.ndarray:
    x = np.zeros((len(values), width))
    for row, at, v in zip(x, indices, values):
        row[slice(None) if at is None else at] = v
    return x


def _passes(state: np.ndarray, steps: int, sizes: Sequence[int], passes: int, seed: int):
    n = len(state) // 3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # the rows of one cached partition
        if not parts or not sum(map(len, parts)):
            return
        rows = pd.concat(parts, ignore_index=True)
        w, m, v = (state[k * n : (k + 1) * n].copy() for k in range(3))
        rng = np.random.default_rng([seed, steps, TaskContext.get().partitionId()])
        t = steps
        y = rows["y"].to_numpy()
        batch = int(np.clip(len(rows) // 20, SMALLEST_BATCH, BATCH))  # few rows still give a pass several steps
        for _ in range(passes):
            for at in np.array_split(rng.permutation(len(rows)), -(-len(rows) // batch)):
                g = gradient(dense(rows["indices"].iloc[at], rows["cells"].iloc[at], sizes[0]), y[at], w, sizes)
                t += 1
                m += (1 - BETA1) * (g - m)
                v += (1 - BETA2) * (g * g - v)
                w -= RATE * np.sqrt(1 - BETA2**t) / (1 - BETA1**t) * m / (np.sqrt(v) + TINY)
        flat = np.concatenate([w, m, v]) * len(rows)
        pieces = np.array_split(flat, -(-len(flat) // PIECE))
        yield pd.DataFrame({"piece": range(-1, len(pieces)), "total": [np.array([len(rows), t - steps], float), *pieces]})

    return run


class NetworkClassifier(Estimator, HasFeaturesCol):
    """``hidden`` rectifier layers and a logistic output; ``passes`` over the rows, averaged every ``round_passes``."""

    def __init__(self, hidden: Sequence[int] = (128, 64), passes: int = 300, featuresCol: str = "features", labelCol: str = "type", seed: int = 42, round_passes: int = ROUND_PASSES):
        super().__init__()
        self.hidden, self.passes, self.label, self.seed, self.round_passes = tuple(hidden), passes, labelCol, seed, round_passes
        self._set(featuresCol=featuresCol)

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        name = self.getOrDefault(self.featuresCol)
        cell = F.unwrap_udt(name)
        rows = dataset.select(cell["indices"].alias("indices"), cell["values"].alias("cells"), F.col(self.label).cast("double").alias("y"))
        first = dataset.select(name).first()
        if first is None:
            raise ValueError("no rows to fit")
        sizes = [int(first[0].size), *self.hidden, 1]
        n = sum(a * b for a, b in shapes(sizes))
        state, steps, done = np.concatenate([start_weights(sizes, self.seed), np.zeros(2 * n)]), 0, 0
        while done < self.passes:
            passes = min(self.round_passes, self.passes - done)
            found = rows.mapInPandas(_passes(state, steps, sizes, passes, self.seed), "piece int, total array<double>")
            summed = found.groupBy("piece").agg(Summarizer.sum(array_to_vector("total")).alias("total"), F.max(F.get("total", F.lit(1))).alias("most"))
            got = {r["piece"]: r for r in summed.collect()}
            state = np.concatenate([got[k]["total"].toArray() for k in range(len(got) - 1)]) / got[-1]["total"][0]
            steps, done = steps + int(got[-1]["most"]), done + passes
        return NetworkModel(sizes, state[:n], name)


class NetworkModel(Model, HasFeaturesCol, MLReadable, MLWritable):
    """Adds ``rawPrediction``, ``probability`` and ``prediction``; the weights are saved as a table beside the metadata."""

    sizes = Param(Params._dummy(), "sizes", "units of every layer", TypeConverters.toListInt)

    def __init__(self, sizes: Sequence[int] = (1, 1), weights: np.ndarray | None = None, featuresCol: str = "features"):
        super().__init__()
        self.weights = weights
        self._set(featuresCol=featuresCol, sizes=list(sizes))

    def margin(self) -> Column:
        sizes = self.getOrDefault(self.sizes)
        layers = unpack(self.weights, sizes)

        @F.pandas_udf("double")
        def score(indices: pd.Series, cells: pd.Series) -> pd.Series:
            parts = range(0, len(cells), 1000)
            return pd.Series(np.concatenate([np.zeros(0), *[margins(dense(indices[a : a + 1000], cells[a : a + 1000], sizes[0]), layers) for a in parts]]))

        cell = F.unwrap_udt(self.getOrDefault(self.featuresCol))
        return score(cell["indices"], cell["values"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn("_margin", self.margin()).withColumn("_p", 1 / (1 + F.exp(-F.col("_margin"))))
        out = out.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
        out = out.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
        return out.withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_margin", "_p")

    def write(self) -> MLWriter:
        return _NetworkWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NetworkReader(cls)


class _NetworkWriter(MLWriter):
    def __init__(self, instance: NetworkModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        pieces = np.array_split(self.instance.weights, -(-len(self.instance.weights) // PIECE))
        rows = [(k, p.tolist()) for k, p in enumerate(pieces)]
        self.sparkSession.createDataFrame(rows, "piece int, weights array<double>").write.parquet(f"{path}/weights")


class _NetworkReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NetworkModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/weights").orderBy("piece").collect()
        model = self.cls(weights=np.concatenate([r["weights"] for r in rows]))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
