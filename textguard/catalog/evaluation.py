"""Evaluation, report, run and registry queries.

Predictions come from three rules on the labelled corpus; runs are derived from ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.catalog import base as B
from textguard.catalog.base import query, table
from textguard.functions import text as T
from textguard.operators import metrics, quality, reports

MODELS = ("logistic_regression", "random_forest", "svm", "lightgbm", "mlp")

SCORED_SQL = f"""SELECT doc_id, lang, source, type, p_a, p_b, p_c, CAST(p_a >= 0.5 AS INTEGER) AS pred_a,
  CAST(p_b >= 0.5 AS INTEGER) AS pred_b, CAST(p_c >= 0.5 AS INTEGER) AS pred_c FROM (
  SELECT doc_id, lang, source, type, least(CAST(1 AS DOUBLE), caps * CAST(25 AS DOUBLE) / chars) AS p_a,
    words / CAST(words + 150 AS DOUBLE) AS p_b, (doc_id * 37 % 101) / CAST(100 AS DOUBLE) AS p_c FROM (
    SELECT d.doc_id, d.lang, d.source, l.toxic AS type, len(regexp_extract_all(d.text, '[A-Z]')) AS caps,
      greatest(length(d.text), 1) AS chars, len(regexp_extract_all(d.text, '{B.P.PIECE}')) AS words
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"""


def scored(spark, sf):
    """Labelled documents with three class-1 probabilities and their decisions."""
    docs = B.labelled(spark, sf).select(
        "doc_id",
        "lang",
        "source",
        "type",
        F.least(F.lit(1.0), T.count_capitals("text") * 25.0 / F.greatest(F.length("text"), F.lit(1))).alias("p_a"),
        (T.count_words("text") / (T.count_words("text") + 150.0)).alias("p_b"),
        ((F.col("doc_id") * 37 % 101) / 100.0).alias("p_c"),
    )
    return docs.withColumns({f"pred_{m}": (F.col(f"p_{m}") >= 0.5).cast("int") for m in "abc"})


def _counts_sql(source: str, by: str, pred: str = "pred_a") -> str:
    return f"""SELECT {by} CAST(count(*) AS BIGINT) AS n,
    CAST(coalesce(sum(CASE WHEN type = 0 AND {pred} = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tn,
    CAST(coalesce(sum(CASE WHEN type = 0 AND {pred} = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
    CAST(coalesce(sum(CASE WHEN type = 1 AND {pred} = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn,
    CAST(coalesce(sum(CASE WHEN type = 1 AND {pred} = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp
    FROM {source}"""


def _ratio_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / ({den}) END"


def _binary_sql(counts: str, by: str) -> str:
    return f"""SELECT {by} n, round({_ratio_sql('(tp + tn)', 'n')}, 6) AS accuracy, round({_ratio_sql('tp', '(tp + fp)')}, 6) AS precision,
    round({_ratio_sql('tp', '(tp + fn)')}, 6) AS recall, round({_ratio_sql('(2 * tp)', '(2 * tp + fp + fn)')}, 6) AS f1 FROM ({counts})"""


_P1, _R1, _F1 = _ratio_sql("tp", "(tp + fp)"), _ratio_sql("tp", "(tp + fn)"), _ratio_sql("(2 * tp)", "(2 * tp + fp + fn)")
_P0, _R0, _F0 = _ratio_sql("tn", "(tn + fn)"), _ratio_sql("tn", "(tn + fp)"), _ratio_sql("(2 * tn)", "(2 * tn + fp + fn)")


def _report_sql(counts: str, by: str) -> str:
    wide = f"""SELECT {by} CAST(tn + fp AS DOUBLE) AS s0, CAST(fn + tp AS DOUBLE) AS s1, CAST(n AS DOUBLE) AS n,
      {_P0} AS p0, {_R0} AS r0, {_F0} AS f0, {_P1} AS p1, {_R1} AS r1, {_F1} AS f1x, {_ratio_sql('(tp + tn)', 'n')} AS acc FROM ({counts})"""
    rows = [
        ("0", "p0", "r0", "f0", "s0"),
        ("1", "p1", "r1", "f1x", "s1"),
        ("accuracy", "acc", "acc", "acc", "acc"),
        ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1x) / 2", "n"),
        ("weighted avg", "(p0 * s0 + p1 * s1) / n", "(r0 * s0 + r1 * s1) / n", "(f0 * s0 + f1x * s1) / n", "n"),
    ]
    parts = [
        f"""SELECT {by} '{r}' AS "row", round({p}, 6) AS precision, round({rc}, 6) AS recall, round({f}, 6) AS f1, round({s}, 6) AS support FROM w"""
        for r, p, rc, f, s in rows
    ]
    return f"WITH w AS ({wide}) " + " UNION ALL ".join(parts)


@query("class_distribution", "SELECT toxic, CAST(count(*) AS BIGINT) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic")
def class_distribution(spark, sf):
    return metrics.class_distribution(table(spark, sf, "labels"), "toxic")


@query(
    "confusion_matrix",
    f"""WITH c AS ({_counts_sql(f'({SCORED_SQL})', '')})
    SELECT 0 AS actual, 0 AS predicted, tn AS n FROM c UNION ALL SELECT 0, 1, fp FROM c
    UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c""",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(scored(spark, sf), pred="pred_a")


@query("classification_report", _report_sql(_counts_sql(f"({SCORED_SQL})", "lang,") + " GROUP BY lang", "lang,"))
def classification_report(spark, sf):
    return metrics.classification_report(scored(spark, sf), pred="pred_a", by=["lang"], digits=6)


@query("binary_metrics", _binary_sql(_counts_sql(f"({SCORED_SQL})", "source,", "pred_b") + " GROUP BY source", "source,"))
def binary_metrics(spark, sf):
    return metrics.binary_metrics(scored(spark, sf), pred="pred_b", by=["source"], digits=6)


@query(
    "correctness_distribution",
    f"SELECT type, type = pred_a AS correct, CAST(count(*) AS BIGINT) AS n FROM ({SCORED_SQL}) GROUP BY ALL",
)
def correctness_distribution(spark, sf):
    return metrics.correctness_distribution(scored(spark, sf), pred="pred_a")


_SOURCE_F1 = _binary_sql(_counts_sql(f"({SCORED_SQL})", "lang, source,", "pred_b") + " GROUP BY lang, source", "lang, source,")


@query(
    "cv_summary",
    f"""SELECT lang AS model, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std, min(f1) AS f1_min, max(f1) AS f1_max
    FROM ({_SOURCE_F1}) GROUP BY lang""",
)
def cv_summary(spark, sf):
    """Each language plays a model, each source a fold."""
    folds = metrics.binary_metrics(scored(spark, sf), pred="pred_b", by=["lang", "source"], digits=6)
    out = metrics.cv_summary(folds.withColumnRenamed("lang", "model"))
    return out.withColumns({c: F.round(c, 6) for c in ("f1_mean", "f1_std")})


def _pairs_sql(cell: str, name: str) -> str:
    parts = []
    for a in "abc":
        for b in "abc":
            value = "CAST(1 AS DOUBLE)" if a == b else f"round({cell.format(a=a, b=b)}, 6)"
            parts.append(f"SELECT 'pred_{a}' AS model_a, 'pred_{b}' AS model_b, {value} AS {name} FROM s")
    return f"WITH s AS ({SCORED_SQL}) " + " UNION ALL ".join(p.replace(" FROM s", " FROM s" if "round" in p else " FROM (SELECT 1)") for p in parts)


PREDS = ["pred_a", "pred_b", "pred_c"]


@query("agreement_matrix", _pairs_sql("avg(CASE WHEN pred_{a} = pred_{b} THEN CAST(1 AS DOUBLE) ELSE 0 END)", "agreement"))
def agreement_matrix(spark, sf):
    return metrics.agreement_matrix(scored(spark, sf), PREDS).withColumn("agreement", F.round("agreement", 6))


@query("prediction_correlation", _pairs_sql("corr(pred_{a}, pred_{b})", "correlation"))
def prediction_correlation(spark, sf):
    return metrics.prediction_correlation(scored(spark, sf), PREDS).withColumn("correlation", F.round("correlation", 6))


@query(
    "ensemble_vs_members",
    " UNION ALL ".join(
        f"SELECT 'pred_{m}' AS model, * FROM ({_binary_sql(_counts_sql(f'({SCORED_SQL})', '', f'pred_{m}'), '')})" for m in "abc"
    ),
)
def ensemble_vs_members(spark, sf):
    return metrics.compare_predictions(scored(spark, sf), PREDS, digits=6)


# --- reports -------------------------------------------------------------------------------------

_REPORT_FILES = (
    "(CASE lang WHEN 'en' THEN 'random_forest' WHEN 'fr' THEN 'svm' WHEN 'de' THEN 'mlp' ELSE 'logistic_regression' END)"
    " || '_' || (CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'roberta' WHEN source IN ('src3', 'src4') THEN 'bert'"
    " WHEN source IN ('src5', 'src6') THEN 'tfidf' ELSE 'glove' END) || '_report.csv'"
)
_LONG_REPORTS_SQL = _report_sql(
    _counts_sql(f"(SELECT *, {_REPORT_FILES} AS file_name FROM ({SCORED_SQL}))", "file_name,", "pred_b") + " GROUP BY file_name",
    "file_name,",
)
_RECAP_SQL = f"""SELECT regexp_extract(file_name, '^(.*)_(tfidf|bow|word2vec|glove|bert|roberta)_report', 1) AS model,
  regexp_extract(file_name, '^(.*)_(tfidf|bow|word2vec|glove|bert|roberta)_report', 2) AS embedding,
  max(CASE WHEN "row" = 'accuracy' THEN precision END) AS accuracy, max(CASE WHEN "row" = '1' THEN precision END) AS precision,
  max(CASE WHEN "row" = '1' THEN recall END) AS recall, max(CASE WHEN "row" = '1' THEN f1 END) AS f1
  FROM ({_LONG_REPORTS_SQL}) GROUP BY file_name"""


def _long_reports(spark, sf):
    docs = scored(spark, sf).withColumn("file_name", F.expr(_REPORT_FILES))
    return metrics.classification_report(docs, pred="pred_b", by=["file_name"], digits=6)


@query("recap", _RECAP_SQL)
def recap(spark, sf):
    return reports.recap_reports(_long_reports(spark, sf))


@query(
    "pivot_f1",
    "SELECT model, "
    + ", ".join(f"round(avg(CASE WHEN embedding = '{e}' THEN f1 END), 6) AS {e}" for e in reports.EMBEDDINGS)
    + f" FROM ({_RECAP_SQL}) GROUP BY model",
)
def pivot_f1(spark, sf):
    out = reports.pivot_metric(reports.recap_reports(_long_reports(spark, sf)))
    return out.withColumns({e: F.round(e, 6) for e in reports.EMBEDDINGS})


@query(
    "melt_metrics",
    " UNION ALL ".join(f"SELECT model, embedding, '{m}' AS metric, {m} AS score FROM ({_RECAP_SQL})" for m in reports.METRICS),
)
def melt_metrics(spark, sf):
    return reports.melt_metrics(reports.recap_reports(_long_reports(spark, sf)), ["model", "embedding"])


@query(
    "filter_results",
    f"SELECT model, embedding, f1 FROM ({_RECAP_SQL}) WHERE model IN ('svm', 'mlp') AND embedding IN ('bert', 'roberta')",
)
def filter_results(spark, sf):
    rows = quality.isin_all(
        reports.recap_reports(_long_reports(spark, sf)), {"model": ["svm", "mlp"], "embedding": ["bert", "roberta"]}
    )
    return reports.rank_by(rows, "f1", "model", "embedding").select("model", "embedding", "f1")


# --- runs and registry ---------------------------------------------------------------------------

_RUNS = """SELECT event_id AS run_id, event_type AS run_name, ts AS start_time, value,
  CASE k % 7 WHEN 0 THEN 'tfidf' WHEN 1 THEN 'bow' WHEN 2 THEN 'word2vec' WHEN 3 THEN 'glove' WHEN 4 THEN 'bert' WHEN 5 THEN 'roberta' END AS embedding,
  CASE user_id % 6 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'random_forest' WHEN 2 THEN 'svm' WHEN 3 THEN 'lightgbm' WHEN 4 THEN 'mlp' END AS model,
  (event_id * 37 % 1009) / CAST(1008 AS DOUBLE) AS f1, (event_id * 91 % 1013) / CAST(1012 AS DOUBLE) AS accuracy,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'ds' || CAST(user_id % 8 AS VARCHAR(8)) END AS dataset, k AS samples
  FROM ({src})"""
_RUNS_SQL = _RUNS.format(src="SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")


def runs(spark, sf):
    """Every event as one run: parameters and metrics from its columns, end = start + value seconds."""
    src = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    frame = spark.sql(_RUNS.format(src="SELECT * FROM {events}"), events=src)
    micros = F.round(F.col("value") * 1e6).cast("long")
    return frame.withColumn("end_time", F.timestamp_add("MICROSECOND", micros, F.col("start_time")))


@query("run_duration", f"SELECT run_id, round(CAST(round(value * CAST(1000000 AS DOUBLE)) AS BIGINT) / CAST(1000000 AS DOUBLE), 6) AS duration FROM ({_RUNS_SQL})")
def run_duration(spark, sf):
    return reports.run_duration(runs(spark, sf)).select("run_id", F.round("duration", 6).alias("duration"))


@query("latest_runs", f"SELECT run_id, run_name FROM ({_RUNS_SQL}) ORDER BY start_time DESC, run_id LIMIT 50")
def latest_runs(spark, sf):
    return reports.latest_runs(runs(spark, sf), 50).select("run_id", "run_name")


@query(
    "filter_runs",
    f"SELECT run_id, embedding, model FROM ({_RUNS_SQL}) WHERE (embedding IN ('bert', 'bow') OR embedding IS NULL) AND (model IN ('svm') OR model IS NULL)",
)
def filter_runs(spark, sf):
    return reports.filter_runs(runs(spark, sf), {"embedding": ["bert", "bow"], "model": ["svm"]}).select(
        "run_id", "embedding", "model"
    )


@query(
    "runs_with_metrics",
    f"SELECT run_id FROM ({_RUNS_SQL}) WHERE NOT (embedding IS NULL AND model IS NULL)",
)
def runs_with_metrics(spark, sf):
    return quality.drop_nulls(runs(spark, sf), ["embedding", "model"], how="all").select("run_id")


@query(
    "mean_by_route",
    f"SELECT embedding, model, round(avg(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1 FROM ({_RUNS_SQL}) GROUP BY embedding, model",
)
def mean_by_route(spark, sf):
    out = reports.mean_by_route(runs(spark, sf))
    return out.withColumns({m: F.round(m, 6) for m in ("accuracy", "f1")})


@query(
    "dataset_summary",
    f"""SELECT dataset, round(avg(accuracy), 3) AS accuracy_mean, round(max(accuracy), 3) AS accuracy_max, round(min(accuracy), 3) AS accuracy_min,
    round(avg(f1), 3) AS f1_mean, round(max(f1), 3) AS f1_max, round(min(f1), 3) AS f1_min, arg_min(samples, run_id) AS samples_first
    FROM ({_RUNS_SQL}) GROUP BY dataset""",
)
def dataset_summary(spark, sf):
    return reports.dataset_summary(runs(spark, sf), seq="run_id")


@query(
    "metric_evolution",
    f"""SELECT run_id, CAST(row_number() OVER (ORDER BY start_time, run_id) - 1 AS BIGINT) AS test_number,
    round(max(f1) OVER (ORDER BY start_time, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_f1 FROM ({_RUNS_SQL})""",
)
def metric_evolution(spark, sf):
    out = reports.metric_evolution(runs(spark, sf), "f1")
    return out.select("run_id", "test_number", F.round("best_f1", 6).alias("best_f1"))


_REGISTRY_SQL = f"""SELECT 'model_' || CAST(run_id AS VARCHAR) AS model_id, run_name AS name, embedding, dataset,
  CASE WHEN run_id % 13 = 0 THEN NULL ELSE accuracy END AS accuracy, CASE WHEN run_id % 17 = 0 THEN NULL ELSE f1 END AS f1,
  strftime(start_time, '%Y%m%d_%H%M%S') AS timestamp FROM ({_RUNS_SQL})"""


def registry(spark, sf):
    r = runs(spark, sf)
    return r.select(
        F.concat(F.lit("model_"), F.col("run_id").cast("string")).alias("model_id"),
        F.col("run_name").alias("name"),
        "embedding",
        "dataset",
        F.when(F.col("run_id") % 13 != 0, F.col("accuracy")).alias("accuracy"),
        F.when(F.col("run_id") % 17 != 0, F.col("f1")).alias("f1"),
        F.date_format("start_time", "yyyyMMdd_HHmmss").alias("timestamp"),
    )


_LISTING_SQL = f"""SELECT model_id, coalesce(name, 'Unknown') AS name, coalesce(embedding, 'Unknown') AS embedding,
  coalesce(dataset, 'Unknown') AS dataset, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(f1, 0), 6) AS f1, timestamp
  FROM ({_REGISTRY_SQL})"""


def _rounded(df):
    return df.withColumns({m: F.round(m, 6) for m in ("accuracy", "f1")})


@query("registry_list", _LISTING_SQL)
def registry_list(spark, sf):
    return _rounded(reports.list_models(registry(spark, sf)))


@query("registry_filtered", _LISTING_SQL + " WHERE embedding = 'bert' AND dataset = 'ds3'")
def registry_filtered(spark, sf):
    return _rounded(reports.list_models(registry(spark, sf), {"embedding": "bert", "dataset": "ds3"}))


@query("best_model", _LISTING_SQL + " ORDER BY f1 DESC, timestamp DESC, model_id LIMIT 1")
def best_model(spark, sf):
    return _rounded(reports.best_model(registry(spark, sf)))
