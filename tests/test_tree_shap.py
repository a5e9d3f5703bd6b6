"""Shapley values of trees against subset enumeration and the models' outputs."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors

from textguard.errors import UnknownMethodError
from textguard.operators import tree_shap as T

WIDTH = 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, WIDTH)), 2)
    x[rng.random(x.shape) < 0.3] = 0
    y = ((x[:, 0] * x[:, 1] + x[:, 2] - 0.5 * x[:, 3] * x[:, 4] + 0.3 * rng.normal(size=400)) > 0).astype(float)
    rows = [(k, Vectors.dense(v) if k % 2 else SparseVector(WIDTH, np.flatnonzero(v), v[np.flatnonzero(v)]), float(y[k])) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, ["doc_id", "features", "type"]).repartition(4), x


MODELS = {
    "forest": lambda: RandomForestClassifier(featuresCol="features", labelCol="type", numTrees=4, maxDepth=5, seed=1),
    "tree": lambda: DecisionTreeClassifier(featuresCol="features", labelCol="type", maxDepth=4),
    "boosted": lambda: GBTClassifier(featuresCol="features", labelCol="type", maxIter=4, maxDepth=3, seed=1),
}


def known_output(nodes, x, known, boosted):
    """Expected output if only the features ``known`` are known: both ways by cover elsewhere."""

    def walk(at, tree):
        node = tree[at]
        cover, value = T.cover_and_value(node, boosted)
        if node.leftChild < 0:
            return value
        if node.feature in known:
            return walk(node.leftChild if x[node.feature] <= node.cut[0] else node.rightChild, tree)
        return sum(T.cover_and_value(tree[c], boosted)[0] / cover * walk(c, tree) for c in (node.leftChild, node.rightChild))

    return sum(tree[0].weight * walk(0, tree) for tree in nodes)


@pytest.mark.parametrize("kind", MODELS)
def test_values_equal_subset_enumeration(data, kind):
    df, x = data
    model = MODELS[kind]().fit(df)
    nodes = [{r.id: r for r in rows.itertuples()} for _, rows in T.node_table(model).groupby("tree")]
    got = {(r["doc_id"], r["feature"]): r["value"] for r in T.tree_shap(df.where("doc_id < 6"), model).collect()}
    for doc in range(6):
        for j in range(WIDTH):
            others, value = [f for f in range(WIDTH) if f != j], 0.0
            for n in range(WIDTH):
                for s in combinations(others, n):
                    gain = known_output(nodes, x[doc], {*s, j}, kind == "boosted") - known_output(nodes, x[doc], set(s), kind == "boosted")
                    value += factorial(n) * factorial(WIDTH - 1 - n) / factorial(WIDTH) * gain
            assert got.get((doc, j), 0.0) == pytest.approx(value, abs=1e-10)


@pytest.mark.parametrize("kind", MODELS)
def test_values_add_up_to_the_output(data, kind):
    df, _ = data
    model = MODELS[kind]().fit(df)
    total = {r["doc_id"]: r["s"] for r in T.tree_shap(df, model).groupBy("doc_id").agg({"value": "sum"}).withColumnRenamed("sum(value)", "s").collect()}
    column = "rawPrediction" if kind == "boosted" else "probability"
    expected = T.expected_output(model)
    for r in model.transform(df).select("doc_id", vector_to_array(column)[1].alias("p")).collect():
        assert total.get(r["doc_id"], 0.0) == pytest.approx(r["p"] - expected, abs=1e-9)


def test_other_models_and_constant_trees(spark, data):
    df, _ = data
    with pytest.raises(UnknownMethodError):
        T.tree_shap(df, LogisticRegression(featuresCol="features", labelCol="type").fit(df))
    flat = MODELS["tree"]().fit(df.limit(1).union(df.limit(1)))
    assert T.tree_shap(df, flat).count() == 0 and T.expected_output(flat) in (0.0, 1.0)
