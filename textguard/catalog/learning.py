"""Classifier, ensemble and tuning queries. Settings are small; every row of the tables is used."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textguard.catalog import base as B
from textguard.catalog.base import query, table, texts
from textguard.catalog.evaluation import SCORED_SQL, scored
from textguard.operators import ensemble as E
from textguard.operators import models as M
from textguard.operators import tuning
from textguard.operators.sampling import train_test_split
from textguard.operators.vectorize import TextVectorizer
from textguard.plans.train import train
from textguard.session import shared_folder
from textguard.sources.registry import load_model
from textguard.streaming.lockout import LockoutRules
from textguard.streaming.lockout import lockout as lockout_batch

FEATURES = 200
PARAMS = {
    "logistic_regression": {"max_iter": 50},
    "random_forest": {"n_estimators": 20, "max_depth": 6},
    "svm": {"kernel": "rbf", "components": 128, "max_iter": 30},
    "lightgbm": {"n_estimators": 8, "max_depth": 3, "select_features": 50},
    "mlp": {"hidden_layer_sizes": (16, 8), "max_iter": 30},
}
SHORT = {"logistic_regression": "lr", "random_forest": "rf", "svm": "svm", "lightgbm": "gbt", "mlp": "mlp"}


def corpus(spark, sf):
    return B.labelled(spark, sf).select("doc_id", "text", "type")


def vectorizer() -> TextVectorizer:
    return TextVectorizer("tfidf", max_features=FEATURES, stop_words=B.STOP_WORDS)


def features(spark, sf):
    docs = corpus(spark, sf)
    return vectorizer().fit(docs).transform(docs).drop("text")


_METRICS = ("precision", "recall", "f1")
_TEST_SQL = f"""SELECT type, row_number() OVER ({{by}} ORDER BY {B.sql_key('doc_id')}) <= ceil(count(*) OVER ({{by}}) * CAST(0.2 AS DOUBLE)) AS test, doc_id
  FROM ({B.LABELLED_SQL})"""


def _valid(columns=_METRICS):
    """Every score is a share. What a fit scores exactly is no matter for SQL; ids, rows and supports are."""
    return reduce(and_, [F.col(c).between(0, 1) for c in columns])


def _report_sql(model: str) -> str:
    return f"""WITH c AS (SELECT CAST(sum(CAST(type = 0 AS INTEGER)) AS DOUBLE) AS s0, CAST(sum(CAST(type = 1 AS INTEGER)) AS DOUBLE) AS s1
      FROM ({_TEST_SQL.format(by='')}) WHERE test)
    SELECT '{model}' AS model, 'tfidf' AS embedding, r AS row, CASE r WHEN '0' THEN s0 WHEN '1' THEN s1 WHEN 'accuracy' THEN NULL ELSE s0 + s1 END AS support,
      TRUE AS valid FROM c, (SELECT unnest(['0', '1', 'accuracy', 'macro avg', 'weighted avg']) AS r)"""


def _register_training() -> None:
    for key, short in SHORT.items():

        def run(spark, sf, key=key):
            result = train(corpus(spark, sf), "tfidf", [key], PARAMS, max_features=FEATURES, stop_words=B.STOP_WORDS)
            support = F.when(F.col("row") != "accuracy", F.col("support")).alias("support")
            return result.report.select("model", "embedding", "row", support, _valid().alias("valid"))

        query(f"train_{short}", _report_sql(key))(run)


_register_training()


@query("predict", "SELECT doc_id, TRUE AS valid, TRUE AS agrees FROM documents")
def predict(spark, sf):
    """A pipeline fitted on the labelled part scores every document."""
    result = train(
        corpus(spark, sf), "tfidf", ["logistic_regression"], PARAMS, max_features=FEATURES, stop_words=B.STOP_WORDS
    )
    out = M.predict(texts(spark, sf).select("doc_id", "text"), result.deployable("logistic_regression"), 0.5)
    agrees = (F.col("pred") == (F.col("proba") >= 0.5).cast("int")).alias("agrees")
    return out.select("doc_id", _valid(["proba"]).alias("valid"), agrees)


@query(
    "predict_word2vec",
    "SELECT doc_id, 100 AS dims, TRUE AS is_probability, TRUE AS agrees FROM documents",
)
def predict_word2vec(spark, sf):
    """Word vectors and classifier fitted on the labelled part, saved, loaded and applied to every raw document."""
    root = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    result = train(
        corpus(spark, sf), "word2vec", ["logistic_regression"], PARAMS, registry_root=root, save_model="logistic_regression"
    )
    model = load_model(spark, root, result.model_id)
    vectors = model.stages[0].transform(texts(spark, sf).select("doc_id", "text"))
    out = M.predict(vectors, model.stages[1], 0.5)
    return out.select(
        "doc_id", F.size(vector_to_array("features")).alias("dims"), F.col("proba").between(0, 1).alias("is_probability"),
        (F.col("pred") == (F.col("proba") >= 0.5).cast("int")).alias("agrees"),
    )


@query("stacking", f"SELECT doc_id, TRUE AS valid, TRUE AS agrees FROM ({_TEST_SQL.format(by='PARTITION BY type')}) WHERE test")
def stacking(spark, sf):
    parts = train_test_split(features(spark, sf), 0.2, stratify="type")
    members = {k: PARAMS[k] for k in ("logistic_regression", "random_forest")}
    model = E.fit_stacking(parts.where("split = 'train'").drop("split"), members, k=3)
    agrees = (F.col("pred") == (F.col("proba") > 0.5).cast("int")).alias("agrees")
    return model.transform(parts.where("split = 'test'")).select("doc_id", _valid(["proba"]).alias("valid"), agrees)


@query("voting", f"SELECT CAST(count(*) AS BIGINT) AS n, TRUE AS valid FROM ({_TEST_SQL.format(by='PARTITION BY type')}) WHERE test")
def voting(spark, sf):
    parts = train_test_split(features(spark, sf), 0.2, stratify="type")
    members = {k: PARAMS[k] for k in ("logistic_regression", "random_forest")}
    model = E.fit_voting(parts.where("split = 'train'"), members)
    return E.evaluate_ensemble(model, parts.where("split = 'test'")).select("n", _valid().alias("valid"))


@query("cv_compare", "SELECT unnest(['logistic_regression', 'random_forest']) AS model, TRUE AS valid")
def cv_compare(spark, sf):
    members = {k: PARAMS[k] for k in ("logistic_regression", "random_forest")}
    out = E.compare_models(features(spark, sf), members, k=3)
    ordered = (F.col("f1_min") <= F.col("f1_mean") + 1e-12) & (F.col("f1_mean") <= F.col("f1_max") + 1e-12)
    return out.select("model", (_valid(["f1_min", "f1_mean", "f1_max"]) & ordered).alias("valid"))


_SMALL_SPACES = {
    "logistic_regression": lambda r: {**tuning.SPACES["logistic_regression"](r), "max_iter": 20},
    "random_forest": lambda r: {**tuning.SPACES["random_forest"](r), "n_estimators": 10, "max_depth": 5},
    "svm": lambda r: {**tuning.SPACES["svm"](r), "components": 64, "max_iter": 10},
    "lightgbm": lambda r: {**tuning.SPACES["lightgbm"](r), "n_estimators": 3, "max_depth": 3, "select_features": 20},
    "mlp": lambda r: {"hidden_layer_sizes": (8,), "max_iter": 10},
}


def _register_tuning() -> None:
    for key, short in SHORT.items():

        def run(spark, sf, key=key):
            history = tuning.tune(features(spark, sf), key, n_trials=2, cv=2, space=_SMALL_SPACES[key]).history
            return history.select("trial", "state", _valid(["value"]).alias("valid"))

        query(f"tune_{short}", "SELECT CAST(unnest([0, 1]) AS INTEGER) AS trial, 'COMPLETE' AS state, TRUE AS valid")(run)


_register_tuning()


@query(
    "tune_halving",
    """SELECT * FROM (VALUES ('COMPLETE', CAST(2 AS INTEGER), CAST(1 AS BIGINT)), ('PRUNED', 0, 6), ('PRUNED', 1, 2)) t(state, rung, trials)
    WHERE (SELECT count(*) FROM documents) > 0""",
)
def tune_halving(spark, sf):
    """Nine trials over the full space of the linear model in three rungs: nine, three and one trial."""
    history = tuning.tune_by_halving(features(spark, sf), "logistic_regression", n_trials=9, cv=2).history
    return history.groupBy("state", "rung").agg(F.countDistinct("trial").alias("trials"))


# --- combination of given predictions ----------------------------------------------------------------


@query("threshold_decision", f"SELECT doc_id, CASE WHEN p_b >= CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END AS pred FROM ({SCORED_SQL})")
def threshold_decision(spark, sf):
    return scored(spark, sf).select("doc_id", M.decide("p_b", 0.6).alias("pred"))


@query(
    "soft_vote",
    f"""SELECT doc_id, CAST((p_a + p_b + p_c) / 3 > 0.5 AS INTEGER) AS pred, round((p_a + p_b + p_c) / 3, 6) AS proba FROM ({SCORED_SQL})""",
)
def soft_vote(spark, sf):
    pred, proba = E.soft_vote(["p_a", "p_b", "p_c"])
    return scored(spark, sf).select("doc_id", pred.alias("pred"), F.round(proba, 6).alias("proba"))


@query("hard_vote", f"SELECT doc_id, CASE WHEN pred_a + pred_b + pred_c >= 2 THEN 1 ELSE 0 END AS pred FROM ({SCORED_SQL})")
def hard_vote(spark, sf):
    return scored(spark, sf).select("doc_id", E.hard_vote(["pred_a", "pred_b", "pred_c"]).alias("pred"))


@query(
    "multi_route_vote",
    f"""SELECT doc_id, CAST((p_a + p_b + p_c) / 3 > 0.5 AS INTEGER) AS pred, round((p_a + p_b + p_c) / 3, 6) AS proba
    FROM ({SCORED_SQL}) WHERE lang <> 'de'""",
)
def multi_route_vote(spark, sf):
    """Three routes, one of which covers fewer documents; only common documents get a vote."""
    s = scored(spark, sf)
    routes = {m: s.select("doc_id", F.col(f"pred_{m}").alias("pred"), F.col(f"p_{m}").alias("proba")) for m in "ab"}
    routes["c"] = s.where("lang <> 'de'").select("doc_id", F.col("pred_c").alias("pred"), F.col("p_c").alias("proba"))
    out = E.combine_routes(routes)
    return out.withColumn("proba", F.round("proba", 6))


@query(
    "onehot_proba",
    f"""SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN 1 - CAST(pred_a AS DOUBLE) ELSE 1 - p_a END, 6) AS p0,
    round(CASE WHEN doc_id % 3 = 0 THEN CAST(pred_a AS DOUBLE) ELSE p_a END, 6) AS p1 FROM ({SCORED_SQL})""",
)
def onehot_proba(spark, sf):
    known = F.when(F.col("doc_id") % 3 != 0, F.col("p_a"))
    s = scored(spark, sf).select("doc_id", E.one_hot_proba(known, F.col("pred_a")).alias("p"))
    return s.select("doc_id", F.round(F.col("p")[0], 6).alias("p0"), F.round(F.col("p")[1], 6).alias("p1"))


_WINDOW, _LOCK = 72 * 3600.0, 900.0


@query(
    "lockout",
    f"""WITH RECURSIVE a AS (SELECT user_id, epoch(ts) AS sec, event_type = 'purchase' AS ok,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'purchase')),
    s AS (
      SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS fails, CAST(NULL AS DOUBLE) AS until, CAST(NULL AS VARCHAR) AS outcome
      FROM (SELECT DISTINCT user_id FROM a)
      UNION ALL
      SELECT user_id, rn,
        CASE WHEN locked THEN fails WHEN trip OR ok THEN CAST([] AS DOUBLE[]) ELSE list_append(recent, sec) END,
        CASE WHEN locked THEN until WHEN trip THEN sec + {_LOCK} END,
        CASE WHEN locked OR trip THEN 'rejected' WHEN ok THEN 'accepted' ELSE 'failed' END
      FROM (SELECT *, NOT locked AND len(recent) >= 5 AS trip FROM (
        SELECT *, list_filter(CASE WHEN until IS NOT NULL AND NOT locked THEN CAST([] AS DOUBLE[]) ELSE fails END, lambda t: t > sec - {_WINDOW}) AS recent
        FROM (SELECT a.*, s.fails, s.until, coalesce(a.sec < s.until, false) AS locked FROM s JOIN a ON a.user_id = s.user_id AND a.rn = s.rn + 1))))
    SELECT user_id, outcome, CAST(count(*) AS BIGINT) AS n FROM s WHERE rn > 0 GROUP BY user_id, outcome""",
)
def lockout(spark, sf):
    """Errors are failures, purchases successes; with the default hour nobody would ever be locked."""
    attempts = (
        table(spark, sf, "events")
        .where(F.col("event_type").isin("error", "purchase"))
        .select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("ok"))
    )
    rules = LockoutRules(window_seconds=_WINDOW, lockout_seconds=_LOCK)
    out = lockout_batch(attempts, rules)
    return out.groupBy("user_id", "outcome").agg(F.count("*").alias("n"))
