"""Explanation queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textguard.catalog import base as B
from textguard.catalog.base import query, table
from textguard.catalog.learning import FEATURES, PARAMS, corpus, vectorizer
from textguard.functions import text as T
from textguard.operators import explain as X
from textguard.operators import models as M
from textguard.operators.reports import top_words as words_by_impact
from textguard.operators.tree_shap import expected_output
from textguard.operators.tree_shap import tree_shap as tree_values
from textguard.plans.train import train

_WEIGHTS = [((j * 7) % 11 - 5) / 10.0 for j in range(64)]


@query(
    "linear_shap",
    """WITH l AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    m AS (SELECT feature, avg(x) AS mean FROM l GROUP BY feature)
    SELECT vec_id, feature, round((x - mean) * (((feature * 7) % 11 - 5) / CAST(10 AS DOUBLE)), 6) AS value FROM l JOIN m USING (feature)""",
)
def linear_shap(spark, sf):
    vecs = table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return X.linear_shap(vecs, _WEIGHTS, id_col="vec_id").withColumn("value", F.round("value", 6))


@query(
    "top_features",
    """WITH l AS (SELECT generate_subscripts(embedding, 1) - 1 AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    a AS (SELECT feature, avg(abs(x)) AS m FROM l GROUP BY feature ORDER BY m DESC, feature LIMIT 10)
    SELECT 'Feature_' || feature AS feature, round(m, 6) AS mean_abs FROM a""",
)
def top_features(spark, sf):
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "value"))
    long = long.withColumn("value", F.col("value").cast("double"))
    return X.top_features(long, 10).withColumn("mean_abs", F.round("mean_abs", 6))


def _explained(spark, sf):
    """The components of a vector play the weights of its words."""
    words = F.transform(
        "embedding",
        lambda x, i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("word"), x.cast("double").alias("weight")),
    )
    return table(spark, sf, "embeddings").select("vec_id", words.alias("explanation"))


_EXPLAINED_SQL = """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS rank, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings"""


@query(
    "explanation_rows",
    f"""SELECT vec_id, rank, printf('%s %s: %.3f', CASE WHEN w > 0 THEN '+' ELSE '-' END, 'w' || rank, w) AS line FROM ({_EXPLAINED_SQL})""",
)
def explanation_rows(spark, sf):
    return X.explanation_rows(_explained(spark, sf), "vec_id").select("vec_id", "rank", "line")


@query(
    "top_words",
    f"""SELECT 'w' || rank || '/' || vec_id AS word, round(abs(w), 6) AS impact, CASE WHEN w > 0 THEN 'Cyberbullying' ELSE 'Normal' END AS direction
    FROM ({_EXPLAINED_SQL}) ORDER BY abs(w) DESC, word LIMIT 10""",
)
def top_words(spark, sf):
    rows = X.explanation_rows(_explained(spark, sf), "vec_id").withColumn(
        "word", F.concat("word", F.lit("/"), F.col("vec_id").cast("string"))
    )
    return words_by_impact(rows, 10).select("word", F.round("impact", 6).alias("impact"), "direction")


_SPAN = "'<span style=\"background-color: rgba({rgb}, {level}); padding: 2px 4px; border-radius: 3px;\">' || w || '</span>'"


@query(
    "highlight_words",
    f"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '{B.P.PIECE}'), lambda w:
      CASE trim(lower(w), '.,!?;:()[]{{}}"''-') WHEN 'the' THEN {_SPAN.format(rgb='255, 0, 0', level='0.49')}
        WHEN 'and' THEN {_SPAN.format(rgb='0, 255, 0', level='1.00')} ELSE w END), ' ') AS html FROM conversations""",
)
def highlight_words(spark, sf):
    words = F.array(
        F.struct(F.lit("the").alias("word"), F.lit(0.25).alias("weight")),
        F.struct(F.lit("and").alias("word"), F.lit(-0.75).alias("weight")),
    )
    conv = B.spread(table(spark, sf, "conversations"))
    return conv.select("conv_id", "turn", T.highlight_words("text", words).alias("html"))


def _linear_model(spark, sf):
    return train(corpus(spark, sf), "tfidf", ["logistic_regression"], PARAMS, max_features=FEATURES, stop_words=B.STOP_WORDS)


@query("lime")
def lime(spark, sf):
    """Local explanations of all benchmark texts under a model of the labelled corpus."""
    model = _linear_model(spark, sf).deployable("logistic_regression")
    out = X.explain_texts(table(spark, sf, "benchmark"), model, id_col="item_id", num_samples=100)
    return X.explanation_rows(out, "item_id").select("item_id", "rank", "word", F.round("weight", 5).alias("weight"))


@query("tree_shap", "SELECT item_id, TRUE AS adds_up FROM benchmark")
def tree_shap(spark, sf):
    """Exact values of a forest for all benchmark texts: with the expected output they add up to the probability."""
    docs = corpus(spark, sf)
    vec = vectorizer().fit(docs)
    model = M.fit_model(vec.transform(docs), "random_forest", PARAMS["random_forest"])
    items = vec.transform(table(spark, sf, "benchmark")).select("item_id", "features")
    values = tree_values(items, model, "item_id").groupBy("item_id").agg(F.sum("value").alias("total"))
    both = M.score(items, model).join(values, "item_id", "left")
    gap = F.col("proba") - F.lit(expected_output(model)) - F.coalesce("total", F.lit(0.0))
    return both.select("item_id", (F.abs(gap) < 1e-9).alias("adds_up"))


@query("permutation_shap")
def permutation_shap(spark, sf):
    """Shapley values of all benchmark texts, reported as the ten strongest features."""
    docs = corpus(spark, sf)
    vec = vectorizer().fit(docs)
    model = M.fit_model(vec.transform(docs), "logistic_regression", PARAMS["logistic_regression"])
    items = vec.transform(table(spark, sf, "benchmark")).select("item_id", "features")
    values = X.permutation_shap(items, model, "item_id", permutations=2)
    return X.top_features(values, 10, rows=items.count()).withColumn("mean_abs", F.round("mean_abs", 6))
