"""Exact Shapley values of tree ensembles, in the number of leaves instead of the number of feature subsets.

Every leaf becomes one row of a table: the features of its path, the interval each must lie in, and the share
of training rows that goes the leaf's way where the feature is unknown. For a data row, a subset of features
that is known contributes the leaf's value times a product over the path, so the values of a leaf's features are
sums over the coefficients of a small polynomial. Rows of a batch that agree on which intervals they meet
share the work. The table is bounded by the model and travels with the tasks; rows stay distributed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.errors import UnknownMethodError
from textguard.session import shared_folder


@dataclass(frozen=True)
class Leaf:
    """``value`` already holds the tree's weight. Feature k of the path must lie in ``(low, high]``."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def _classifier(model: Transformer) -> Transformer:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def node_table(model: Transformer) -> pd.DataFrame:
    """Nodes of all trees (the model's own stored form), with the weight of each tree."""
    model, spark = _classifier(model), SparkSession.active()
    if not isinstance(model, (GBTClassificationModel, RandomForestClassificationModel, DecisionTreeClassificationModel)):
        raise UnknownMethodError(f"{type(model).__name__} is no tree ensemble")
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = "nodeData." if "nodeData" in data.columns else ""
    tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    fields = ["id", "prediction", "impurityStats", "leftChild", "rightChild"]
    split = [F.col(f"{node}split.featureIndex").alias("feature"), F.col(f"{node}split.leftCategoriesOrThreshold").alias("cut"),
             F.col(f"{node}split.numCategories").alias("categories")]
    rows = data.select(tree.alias("tree"), *[F.col(f"{node}{f}").alias(f) for f in fields], *split).toPandas()
    if isinstance(model, GBTClassificationModel):
        weights = dict(enumerate(model.treeWeights))
    else:
        weights = {t: 1.0 / rows.tree.nunique() for t in rows.tree.unique()}
    return rows.assign(weight=rows.tree.map(weights))


def cover_and_value(row, boosted: bool) -> tuple[float, float]:
    """(training weight, output) of a node: a forest gives the share of class 1, boosting the margin."""
    stats = np.asarray(row.impurityStats)
    return (float(stats[0]), float(row.prediction)) if boosted else (float(stats.sum()), float(stats[1] / stats.sum()))


def leaves(model: Transformer) -> tuple[list[Leaf], float]:
    """(leaf table, expected output over the training rows)."""
    boosted = isinstance(_classifier(model), GBTClassificationModel)
    out, expected = [], 0.0
    for _, rows in node_table(model).groupby("tree"):
        nodes = {r.id: r for r in rows.itertuples()}
        stack = [(0, {}, 1.0)]
        while stack:
            at, path, reach = stack.pop()
            node = nodes[at]
            cover, value = cover_and_value(node, boosted)
            if node.leftChild < 0:
                expected += node.weight * value * reach
                if path:
                    features = np.array(sorted(path))
                    low, high, share = (np.array([path[f][k] for f in features], float) for k in range(3))
                    out.append(Leaf(node.weight * value, features, low, high, share))
                continue
            if node.categories != -1:
                raise UnknownMethodError("categorical splits are not supported")
            for child, left in ((node.leftChild, True), (node.rightChild, False)):
                part = cover_and_value(nodes[child], boosted)[0] / cover
                low, high, share = path.get(node.feature, (-np.inf, np.inf, 1.0))
                cut = float(node.cut[0])
                edge = (low, min(high, cut), share * part) if left else (max(low, cut), high, share * part)
                stack.append((child, {**path, node.feature: edge}, reach * part))
    return out, expected


def path_weights(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For patterns x features: what feature k of a path gains per unit of the leaf's value.

    ``met`` says which features of the path meet their interval. The coefficient of ``t ** s`` in the product
    of ``share_j + met_j t`` over the other features sums the subsets of s known features.
    """
    n = met.shape[1]
    weight = np.array([factorial(s) * factorial(n - 1 - s) / factorial(n) for s in range(n)])
    out = np.empty(met.shape)
    for k in range(n):
        terms = np.zeros((len(met), n))
        terms[:, 0] = 1
        for j in range(n):
            if j != k:
                moved = terms[:, :-1] * met[:, j : j + 1]
                terms *= share[j]
                terms[:, 1:] += moved
        out[:, k] = (met[:, k] - share[k]) * (terms @ weight)
    return out


def shapley_values(x: np.ndarray, columns: np.ndarray, table: list[Leaf]) -> np.ndarray:
    """Values for rows ``x`` that hold the features ``columns`` (sorted, all that the table uses)."""
    out = np.zeros(x.shape)
    for leaf in table:
        at = np.searchsorted(columns, leaf.features)
        met = (x[:, at] > leaf.low) & (x[:, at] <= leaf.high)
        patterns, which = np.unique(met, axis=0, return_inverse=True)
        out[:, at] += leaf.value * path_weights(patterns.astype(float), leaf.share)[which.ravel()]
    return out


def tree_shap(df: DataFrame, model: Transformer, id_col: str = "doc_id", features: str = "features") -> DataFrame:
    """(id, feature, value): exact Shapley values of a forest's class 1 probability, or of a boosted margin.

    Unknown features follow the training rows' ways through the tree. Values of a row add up to the model's output
    minus :func:`expected_output`; features without influence have no row. A null vector gives no rows.
    """
    table, _ = leaves(model)
    columns = np.unique(np.concatenate([np.zeros(0, int), *[leaf.features for leaf in table]])).astype(int)
    id_type = df.schema[id_col].dataType.simpleString()
    cell = F.unwrap_udt(features)
    cells = df.where(F.col(features).isNotNull()).select(F.col(id_col).alias("id"), cell["indices"].alias("indices"), cell["values"].alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), len(columns)))
            for row, indices, values in zip(x, batch["indices"], batch["cells"]):
                if indices is None:
                    row[:] = np.asarray(values)[columns]
                elif len(indices):
                    at = np.minimum(np.searchsorted(columns, indices), len(columns) - 1)
                    hit = columns[at] == indices
                    row[at[hit]] = np.asarray(values)[hit]
            found = shapley_values(x, columns, table)
            at, feature = np.nonzero(found)
            yield pd.DataFrame({id_col: batch["id"].to_numpy()[at], "feature": columns[feature].astype("int32"), "value": found[at, feature]})

    schema = f"`{id_col}` {id_type}, feature int, value double"
    return cells.mapInPandas(run, schema) if len(columns) else df.sparkSession.createDataFrame([], schema)


def expected_output(model: Transformer) -> float:
    return leaves(model)[1]
