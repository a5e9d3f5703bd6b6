import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textguard.operators import explain as X
from textguard.operators import models as M
from textguard.plans.train import train


@pytest.fixture(scope="module")
def text_model(spark):
    bad, good = "stupid awful loser", "lovely sunny friend"
    rows = [(i, (bad if i % 2 else good) + f" common word{i % 5}", i % 2) for i in range(100)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, type int")
    result = train(corpus, "tfidf", ["logistic_regression"], {"logistic_regression": {"max_iter": 20}}, max_features=20)
    return result.deployable("logistic_regression")


def test_local_explanations(spark, text_model):
    df = spark.createDataFrame(
        [(1, "A stupid, awful day; stupid common thing"), (2, "lovely friend"), (3, ""), (4, None)], "doc_id long, text string"
    )
    out = {r["doc_id"]: r for r in X.explain_texts(df, text_model, num_samples=200).collect()}
    one = {e["word"]: e["weight"] for e in out[1]["explanation"]}
    assert out[1]["pred"] == 1 and out[1]["confidence"] > 0.5
    assert one["stupid"] > 0 and one["awful"] > 0 and abs(one["thing"]) < one["awful"]
    assert all(e["weight"] < 0 for e in out[2]["explanation"]) and out[2]["pred"] == 0
    assert out[3]["explanation"] == [] and out[4]["explanation"] == []
    few = X.explain_texts(df.where("doc_id = 1"), text_model, num_features=2, num_samples=100).first()["explanation"]
    assert {e["word"] for e in few} <= {"stupid", "awful"} and len(few) == 2
    assert [abs(e["weight"]) for e in few] == sorted((abs(e["weight"]) for e in few), reverse=True)


def test_ridge_forms_agree():
    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(12, 12)), rng.normal(size=12), rng.uniform(0.1, 1, 12)
    wide = X.weighted_ridge(np.hstack([x, np.zeros((12, 3))]), y, w, 0.3)
    assert np.allclose(wide[:12], X.weighted_ridge(x, y, w, 0.3)) and np.allclose(wide[12:], 0)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, [float(v) for v in rng.normal(loc=i % 2, size=4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, type int, v array<double>")
    return df.select("doc_id", "type", array_to_vector("v").alias("features")).coalesce(1).cache()


def test_linear_values_add_up(spark, vectors):
    w = [0.5, -1.0, 2.0, 0.0]
    total = X.linear_shap(vectors, w).groupBy("doc_id").agg(F.sum("value").alias("s")).collect()
    x = {r["doc_id"]: r["features"].toArray() for r in vectors.collect()}
    mean = np.mean(list(x.values()), axis=0)
    for r in total:
        assert r["s"] == pytest.approx(np.dot(w, x[r["doc_id"]] - mean))


def test_permutation_values_add_up_to_the_difference(spark, vectors, monkeypatch):
    model = M.fit_model(vectors, "logistic_regression", {"max_iter": 20}, cached=True)
    one = vectors.limit(1)
    values = X.permutation_shap(vectors, model, permutations=6, background=1)
    sums = {r["doc_id"]: r["s"] for r in values.groupBy("doc_id").agg(F.sum("value").alias("s")).collect()}
    proba = {r["doc_id"]: r["proba"] for r in M.score(vectors, model).collect()}
    from textguard.operators.sampling import sample_n

    start = proba[sample_n(vectors, 1).first()["doc_id"]]
    assert one.count() == 1 and len(sums) >= 59
    for doc, s in sums.items():
        assert s == pytest.approx(proba[doc] - start, abs=1e-9)


def test_top_features(spark):
    long = spark.createDataFrame([(1, 0, -2.0), (2, 0, 1.0), (1, 1, 0.5)], "id int, feature int, value double")
    assert [tuple(r) for r in X.top_features(long, 2).collect()] == [("Feature_0", 1.5), ("Feature_1", 0.5)]
    assert [tuple(r) for r in X.top_features(long, 1, ["a", "b"], rows=4).collect()] == [("a", 0.75)]
    classes = long.withColumn("class", F.col("id") - 1)
    assert X.top_features(classes, 5, class_index=1).count() == 1


def test_readable_forms(spark):
    df = spark.createDataFrame([(1, 1, 0.875, [("bad", 0.25), ("ok", -0.125)])], "doc_id long, pred int, confidence double, explanation array<struct<word:string,weight:double>>")
    assert [r["line"] for r in X.explanation_rows(df).orderBy("rank").collect()] == ["+ bad: 0.250", "- ok: -0.125"]
    text = df.select(X.format_explanation(F.col("pred"), F.col("confidence"), F.col("explanation")).alias("t")).first()["t"]
    assert text.splitlines()[1] == "Confidence: 87.50%" and text.splitlines()[-1] == "  - ok: -0.125"
