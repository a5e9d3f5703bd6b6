"""Rectifier network: gradient, a ring that no line separates, averaging over tasks, saving."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from textguard.operators import network as N
from textguard.operators.models import fit_model, score


def ring(spark, n, parts):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (n, 2))
    y = ((x**2).sum(1) < 1.6).astype(int)
    rows = [(k, Vectors.dense(v) if k % 2 else SparseVector(2, [0, 1], v), int(t)) for k, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["doc_id", "features", "type"]).repartition(parts)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    sizes = [3, 5, 4, 1]
    flat, x, y = N.start_weights(sizes, 0) + 0.05, rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)

    def loss(f):
        z = N.margins(x, N.unpack(f, sizes))
        return np.mean(np.logaddexp(0, z) - y * z) + N.PENALTY / len(y) / 2 * sum((w[:-1] ** 2).sum() for w in N.unpack(f, sizes))

    got, step = N.gradient(x, y, flat, sizes), 1e-6
    for k in range(len(flat)):
        move = np.zeros(len(flat))
        move[k] = step
        assert got[k] == pytest.approx((loss(flat + move) - loss(flat - move)) / (2 * step), abs=1e-6)


def test_defaults_separate_a_ring(spark):
    """(128, 64) at 300 passes: rows of one task, and rows averaged over four."""
    for parts in (1, 4):
        docs = ring(spark, 1200, parts).cache()
        model = N.NetworkClassifier().fit(docs.where("doc_id < 800"))
        right = model.transform(docs.where("doc_id >= 800")).agg(F.avg((F.col("prediction") == F.col("type")).cast("int"))).first()[0]
        assert right > 0.95
        docs.unpersist()


def test_network_is_saved_in_a_pipeline(spark, tmp_path):
    docs = ring(spark, 300, 2)
    model = fit_model(docs, "mlp", {"hidden_layer_sizes": (8,), "max_iter": 20})
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    mine, theirs = ({r["doc_id"]: (r["pred"], r["proba"]) for r in score(docs, m).collect()} for m in (model, loaded))
    assert mine == theirs and all(0 <= p <= 1 and k == int(p > 0.5) for k, p in mine.values())
    assert score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        N.NetworkClassifier().fit(docs.limit(0))
