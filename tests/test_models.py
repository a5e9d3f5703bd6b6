import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textguard.errors import UnknownMethodError, UnsupportedParameterError
from textguard.operators import ensemble as E
from textguard.operators import kernels as K
from textguard.operators import models as M
from textguard.operators import tuning
from textguard.operators.metrics import binary_metrics
from textguard.plans.train import quick_route, train
from textguard.sources.registry import load_model, read_registry, save_model


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        label = i % 2
        rows.append((i, label, [float(x) for x in rng.normal(loc=1.5 if label else -1.5, size=3)]))
    df = spark.createDataFrame(rows, "doc_id long, type int, v array<double>")
    return df.select("doc_id", "type", array_to_vector("v").alias("features")).coalesce(2).cache()


@pytest.fixture(scope="module")
def ring(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        r, a = (0.5 if i % 2 else 2.0) + rng.normal(scale=0.1), rng.uniform(0, 6.28)
        rows.append((i, i % 2, [float(r * np.cos(a)), float(r * np.sin(a))]))
    df = spark.createDataFrame(rows, "doc_id long, type int, v array<double>")
    return df.select("doc_id", "type", array_to_vector("v").alias("features")).coalesce(2).cache()


def _f1(df, model):
    return binary_metrics(M.score(df, model), "type", "pred").first()["f1"]


@pytest.mark.parametrize(
    "key,params",
    [
        ("logistic_regression", {}),
        ("random_forest", {"n_estimators": 10, "max_depth": 5}),
        ("svm", {"kernel": "linear"}),
        ("lightgbm", {"n_estimators": 5, "min_child_samples": 1}),
        ("mlp", {"hidden_layer_sizes": (8,), "max_iter": 50}),
    ],
)
def test_models_separate(separable, key, params):
    assert _f1(separable, M.fit_model(separable, key, params, cached=True)) > 0.95


def test_kernels_solve_what_a_line_cannot(ring):
    assert _f1(ring, M.fit_model(ring, "svm", {"kernel": "linear"}, cached=True)) < 0.8
    model = M.fit_model(ring, "svm", {"kernel": "rbf", "components": 128, "probability": True}, cached=True)
    scored = M.score(ring, model)
    assert binary_metrics(scored, "type", "pred").first()["f1"] > 0.95
    p = scored.agg(F.min("proba"), F.max("proba"), F.corr("proba", "type")).first()
    assert 0 <= p[0] < 0.2 and 0.8 < p[1] <= 1 and p[2] > 0.9


def test_feature_maps_approach_the_kernels():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=12), rng.normal(size=12)
    index, gamma, size = np.arange(12), 0.05, 8192
    w, b = K.fourier_weights(12, size, gamma, 7)
    approx = K.fourier_features(index, x, w, b) @ K.fourier_features(index, y, w, b)
    assert approx == pytest.approx(np.exp(-gamma * np.sum((x - y) ** 2)), abs=0.05)
    h, s = K.sketch_hashes(12, size, 3, 7)
    x = x + y  # a larger inner product
    approx = K.polynomial_sketch(index, x, h, s, size, gamma) @ K.polynomial_sketch(index, y, h, s, size, gamma)
    assert approx == pytest.approx((gamma * x @ y) ** 3, abs=0.1)


def test_factory_rules():
    assert M.resolve_params("svm", {"C": 3})["kernel"] == "rbf"
    with pytest.raises(UnknownMethodError):
        M.resolve_params("perceptron")
    with pytest.raises(UnsupportedParameterError):
        M.resolve_params("lightgbm", {"num_leaves": 31})
    with pytest.raises(UnsupportedParameterError):
        M.build_model("random_forest", {"max_depth": 31})
    assert M.deep_merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"x": 5}, "c": 3}) == {"a": {"x": 5, "y": 2}, "b": 1, "c": 3}


def test_gamma_scale(separable):
    x = np.array([r["v"] for r in separable.select(vector_to_array("features").alias("v")).collect()])
    assert M.gamma_of(separable, "scale", 3) == pytest.approx(1 / (3 * x.var()))
    assert M.gamma_of(separable, "auto", 3) == pytest.approx(1 / 3)


def test_penalty_matches_summed_loss(separable):
    """The optimum must not move when every row is doubled and C is halved."""
    one = M.fit_model(separable, "logistic_regression", {"C": 0.02}, cached=True).stages[-1]
    two = M.fit_model(separable.union(separable), "logistic_regression", {"C": 0.01}, cached=True).stages[-1]
    assert np.allclose(one.coefficients.toArray(), two.coefficients.toArray(), atol=1e-3)


def test_voting_and_fallback(separable):
    members = {"logistic_regression": {}, "random_forest": {"n_estimators": 5, "max_depth": 4}}
    soft = E.fit_voting(separable, members)
    assert soft.voting == "soft" and E.evaluate_ensemble(soft, separable).first()["f1"] > 0.95
    with pytest.warns(UserWarning, match="hard voting"):
        hard = E.fit_voting(separable, {"svm": {"kernel": "linear"}}, fitted=soft.members)
    assert hard.voting == "hard" and len(hard.members) == 3
    assert hard.transform(separable).count() == 240


def test_votes_on_ties(spark):
    df = spark.createDataFrame([(0, 1, 0.5, 0.5), (1, 1, 0.9, 0.2)], "pred_a int, pred_b int, p_a double, p_b double")
    pred, proba = E.soft_vote(["p_a", "p_b"])
    rows = df.select(pred.alias("s"), E.hard_vote(["pred_a", "pred_b"]).alias("h")).collect()
    assert [(r["s"], r["h"]) for r in rows] == [(0, 0), (1, 1)]


def test_stacking_rows_come_from_models_that_did_not_see_them(separable, monkeypatch):
    seen = []
    real = E.fit_model

    def spy(train, key, params, seed, **kw):
        seen.append(frozenset(r["doc_id"] for r in train.select("doc_id").collect()))
        return real(train, key, params, seed, **kw)

    monkeypatch.setattr(E, "fit_model", spy)
    members = {"logistic_regression": {"max_iter": 20}}
    model = E.fit_stacking(separable, members, k=3)
    everything = frozenset(range(240))
    assert sorted(map(len, seen)) == [160, 160, 160, 240]
    held_out = [everything - s for s in seen if s != everything]
    assert frozenset().union(*held_out) == everything and sum(map(len, held_out)) == 240
    assert E.evaluate_ensemble(model, separable).first()["f1"] > 0.95


def test_cv_summary_and_tuning(separable):
    table = E.compare_models(separable, {"logistic_regression": {"max_iter": 20}, "random_forest": {"n_estimators": 3, "max_depth": 3}}, k=3)
    rows = table.collect()
    assert [r["f1_mean"] for r in rows] == sorted((r["f1_mean"] for r in rows), reverse=True)
    space = lambda r: {"C": float(r.uniform(0.1, 1)), "max_iter": 10}
    one = tuning.tune(separable, "logistic_regression", n_trials=2, cv=2, space=space)
    two = tuning.tune(separable, "logistic_regression", n_trials=2, cv=2, space=space)
    assert one.best_params == two.best_params and one.best_score > 0.9
    assert [r["state"] for r in one.history.collect()] == ["COMPLETE", "COMPLETE"]
    with pytest.raises(UnknownMethodError):
        tuning.tune(separable, "naive_bayes")


def test_search_spaces_only_hold_known_parameters():
    rng = np.random.default_rng(0)
    for key, space in tuning.SPACES.items():
        for _ in range(20):
            M.build_model(key, space(rng), n_features=4)


@pytest.fixture(scope="module")
def corpus(spark):
    bad, good = "you stupid awful loser go away", "what a lovely sunny day friend"
    rows = [(i, (bad if i % 2 else good) + f" number {i % 7} here", i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, type int")


def test_train_save_load_predict(spark, corpus, tmp_path):
    root = str(tmp_path / "registry")
    assert load_model(spark, root) is None
    result = train(
        corpus, "tfidf", ["logistic_regression", "no_such_model"], {"logistic_regression": {"max_iter": 20}},
        max_features=30, reports_root=str(tmp_path / "reports"), registry_root=root, save_model="logistic_regression",
    )
    assert result.skipped == ["no_such_model"]
    assert spark.read.parquet(str(tmp_path / "reports")).count() == 5
    row = read_registry(spark, root).first()
    assert row["model_id"] == result.model_id and row["f1"] == 1.0 and row["embedding"] == "tfidf"
    fresh = spark.createDataFrame([(1, "stupid loser"), (2, "lovely sunny day"), (3, "unrelated")], "doc_id long, text string")
    for model in (load_model(spark, root), load_model(spark, root, result.model_id)):
        got = {r["doc_id"]: r["pred"] for r in M.predict(fresh, model).collect()}
        assert got[1] == 1 and got[2] == 0
    assert {r["pred"] for r in M.predict(fresh, load_model(spark, root), threshold=0.0).collect()} == {1}
    with pytest.raises(ValueError):
        load_model(spark, root, "nope")


def test_kernel_pipeline_can_be_saved(spark, ring, tmp_path):
    model = M.fit_model(ring, "svm", {"components": 32}, cached=True)
    save_model(spark, model, str(tmp_path / "r"), "svm")
    again = load_model(spark, str(tmp_path / "r"))
    a = [r["pred"] for r in M.score(ring, model).orderBy("doc_id").collect()]
    assert a == [r["pred"] for r in M.score(ring, again).orderBy("doc_id").collect()]


def test_quick_route(corpus):
    result = quick_route(corpus, "bow", ["random_forest"], params={"random_forest": {"n_estimators": 3, "max_depth": 3}}, max_features=20, fit_on="all")
    assert result.report.count() == 5


def test_halving_prunes_and_finishes_in_full(spark):
    rng = np.random.default_rng(0)
    rows = [(k, Vectors.dense([float(k % 2) + rng.normal(scale=0.4), rng.normal()]), k % 2) for k in range(80)]
    df = spark.createDataFrame(rows, ["doc_id", "features", "type"])
    assert tuning.rungs(9, 3) == [(9, 1 / 9), (3, 1 / 3), (1, 1.0)] and tuning.rungs(1, 3) == [(1, 1.0)]
    result = tuning.tune_by_halving(df, "logistic_regression", n_trials=9, cv=2)
    history = {r["trial"]: r for r in result.history.collect()}
    assert sorted(history) == list(range(9)) and len({r["params"] for r in history.values()}) == 9
    assert sorted(r["rung"] for r in history.values()) == [0] * 6 + [1] * 2 + [2]
    last = next(r for r in history.values() if r["state"] == "COMPLETE")
    assert last["rung"] == 2 and str(result.best_params) == last["params"] and result.best_score > 0.7
    # a trial that cannot be fitted loses only itself
    spaces = iter([{"C": 1.0, "max_iter": 5}, {"C": -1.0, "max_iter": 5}, {"C": 10.0, "max_iter": 5}])
    mixed = tuning.tune_by_halving(df, "logistic_regression", n_trials=3, cv=2, space=lambda r: next(spaces)).history.collect()
    assert sorted(r["state"] for r in mixed) == ["COMPLETE", "FAIL", "PRUNED"]


def test_every_route_has_one_vote(spark):
    a = spark.createDataFrame([(1, 1, 0.9), (1, 1, 0.9), (1, 1, 0.9)], "doc_id long, pred int, proba double")
    b, c = (spark.createDataFrame([(1, 0, 0.2)], "doc_id long, pred int, proba double") for _ in range(2))
    soft = E.combine_routes({"a": a, "b": b, "c": c}).first()
    assert soft["pred"] == 0 and soft["proba"] == pytest.approx(1.3 / 3) and E.combine_routes({"a": a, "b": b, "c": c}, "hard").first()["pred"] == 0
