"""Text functions, validation, deduplication, sampling and splitting over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.catalog import base as B
from textguard.catalog.base import query, table, texts
from textguard.functions import text as T
from textguard.operators import metrics, quality, sampling, validate

LIGHT = dict(lowercase=True, remove_urls=True, remove_mentions=True)
NO_NFKC = {
    "validation": validate.DEFAULT_VALIDATION["validation"],
    "cleaning": {**validate.DEFAULT_VALIDATION["cleaning"], "fix_unicode": False},
}

_FIRST = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"
_VALID = f"""SELECT doc_id, lang, {B.sql_light('text')} AS text FROM documents
WHERE doc_id IN ({_FIRST}) AND text IS NOT NULL AND length(text) BETWEEN 3 AND 10000"""

# A document is called abusive here when its cleaned text holds one of these words or it shouts.
LEXICON = ("than", "heer", "sch", "junk", "http", "spam")
_LEXICON_RE = r"\b(" + "|".join(LEXICON) + r")\b"


@query(
    "flagship",
    f"""WITH v AS (SELECT d.doc_id, d.lang, d.text, l.toxic AS type FROM documents d JOIN labels l USING (doc_id)
    WHERE length(d.text) >= 3),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM v) WHERE rn = 1),
  f AS (SELECT lang, type, {B.sql_clean('text')} AS clean, {B.sql_stats('text')} FROM u),
  p AS (SELECT lang, type, CASE WHEN regexp_matches(clean, '{_LEXICON_RE}') OR text_capitals > 0.02 * text_chars THEN 1 ELSE 0 END AS pred
    FROM f WHERE text_words > 3),
  c AS (SELECT lang, CAST(count(*) AS BIGINT) AS n,
      CAST(sum(CASE WHEN type = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN type = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
      CAST(sum(CASE WHEN type = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
    FROM p GROUP BY lang)
  SELECT lang, n, round(CAST(n - fp - fn AS DOUBLE) / n, 6) AS accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1
  FROM c""",
)
def flagship(spark, sf):
    """Labelled corpus -> dedup -> length -> statistics and cleaning -> rule -> quality per language."""
    corpus = quality.min_length(B.labelled(spark, sf), n=3)
    feats = validate.apply_feature_engineering(quality.dedup_keep_first(corpus))
    rule = F.col("text").rlike(_LEXICON_RE) | (F.col("text_capitals") > 0.02 * F.col("text_chars"))
    scored = feats.select("lang", "type", rule.cast("int").alias("pred"))
    return metrics.binary_metrics(scored, by=["lang"], digits=6).select(
        "lang", "n", "accuracy", "precision", "recall", "f1"
    )


@query("text_stats", f"SELECT doc_id, {B.sql_stats('text')} FROM documents")
def text_stats(spark, sf):
    return texts(spark, sf).select("doc_id", *T.text_stats("text"))


@query(
    "page_text_stats",
    f"SELECT page_id, {B.sql_stats('html', 'html')} FROM pages",
)
def page_text_stats(spark, sf):
    return B.spread(table(spark, sf, "pages")).select("page_id", *T.text_stats("html"))


@query("clean_text", f"SELECT doc_id, {B.sql_clean('text')} AS clean FROM documents")
def clean_text(spark, sf):
    return texts(spark, sf).select("doc_id", T.clean_text("text").alias("clean"))


@query("clean_html", f"SELECT page_id, {B.sql_clean('html')} AS clean FROM pages")
def clean_html(spark, sf):
    return B.spread(table(spark, sf, "pages")).select("page_id", T.clean_text("html").alias("clean"))


@query("clean_text_tokens", f"SELECT doc_id, {B.sql_clean('text', keep=True)} AS clean FROM documents")
def clean_text_tokens(spark, sf):
    return texts(spark, sf).select("doc_id", T.clean_text("text", keep_mentions_hashtags=True).alias("clean"))


@query("clean_light", f"SELECT doc_id, {B.sql_light('text')} AS clean FROM documents")
def clean_light(spark, sf):
    return texts(spark, sf).select("doc_id", T.clean_light("text", **LIGHT).alias("clean"))


@query("emoji_strip", f"SELECT doc_id, {B.sql_replace('text', B.P.EMOJI, '')} AS clean FROM documents")
def emoji_strip(spark, sf):
    return texts(spark, sf).select("doc_id", T.strip_emoji("text").alias("clean"))


@query(
    "feature_engineering",
    f"""SELECT * FROM (SELECT doc_id, {B.sql_clean('text')} AS text, {B.sql_stats('text')} FROM documents)
    WHERE text_words > 3""",
)
def feature_engineering(spark, sf):
    return validate.apply_feature_engineering(texts(spark, sf).select("doc_id", "text"))


@query("validate_preprocess", _VALID)
def validate_preprocess(spark, sf):
    return validate.validate_and_preprocess(texts(spark, sf).select("doc_id", "lang", "text"), NO_NFKC)


@query("nfkc_normalize")
def nfkc_normalize(spark, sf):
    return texts(spark, sf).select("doc_id", T.normalize_nfkc("text").alias("text"))


@query(
    "tokenize",
    f"""SELECT doc_id, CAST(len(tok) AS INTEGER) AS n, array_to_string(tok, ' ') AS tokens
    FROM (SELECT doc_id, {B.sql_tokens('text')} AS tok FROM documents)""",
)
def tokenize(spark, sf):
    tok = T.tokenize("text", stop_words=B.STOP_WORDS)
    docs = texts(spark, sf).select("doc_id", tok.alias("tok"))
    return docs.select("doc_id", F.size("tok").alias("n"), F.array_join("tok", " ").alias("tokens"))


@query(
    "bigrams",
    f"""WITH t AS (SELECT doc_id, {B.sql_tokens('text')} AS tok FROM documents)
    SELECT gram, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs
    FROM (SELECT doc_id, unnest(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1])) AS gram FROM t)
    GROUP BY gram""",
)
def bigrams(spark, sf):
    tok = T.tokenize("text", stop_words=B.STOP_WORDS)
    # texts are dealt by id, so the counts of a document need no exchange of its bigrams
    grams = texts(spark, sf).select("doc_id", "text").repartition("doc_id").select("doc_id", tok.alias("tok")).select(
        "doc_id", F.explode(T.ngrams(F.col("tok"), 2)).alias("gram")
    )
    per_doc = grams.groupBy("gram", "doc_id").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("gram").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query("dedup_keep_first", f"SELECT doc_id, lang, source, text FROM documents WHERE doc_id IN ({_FIRST})")
def dedup_keep_first(spark, sf):
    return quality.dedup_keep_first(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))


@query(
    "duplicate_report",
    f"""WITH g AS (SELECT source, {B.sql_strip('text')} AS k, count(*) AS n FROM documents GROUP BY 1, 2),
    r AS (SELECT source, sum(n) AS total, count(*) AS uniq, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS dup,
      sum(CASE WHEN k IS NULL THEN n ELSE 0 END) AS nulls FROM g GROUP BY source)
    SELECT source, CAST(total AS BIGINT) AS total, CAST(uniq AS BIGINT) AS unique_texts,
      CAST(total - uniq AS BIGINT) AS dup_texts, CAST(dup AS BIGINT) AS dup_rows, CAST(nulls AS BIGINT) AS null_texts,
      round(CAST(100 AS DOUBLE) * (total - uniq) / total, 6) AS pct_dup,
      CASE WHEN CAST(100 AS DOUBLE) * (total - uniq) / total < 1 THEN 'OK' ELSE 'DUPLICATES' END AS status FROM r""",
)
def duplicate_report(spark, sf):
    report = quality.duplicate_report(texts(spark, sf))
    return report.withColumn("pct_dup", F.round("pct_dup", 6))


@query(
    "duplicated_rows",
    f"""SELECT doc_id, source FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY {B.sql_strip('text')}) AS n FROM documents)
    WHERE n > 1""",
)
def duplicated_rows(spark, sf):
    return quality.duplicated_rows(texts(spark, sf).select("doc_id", "source", "text")).drop("text")


@query(
    "text_overlap",
    f"""WITH a AS (SELECT DISTINCT {B.sql_strip('text')} AS t FROM documents WHERE doc_id % 2 = 0),
    b AS (SELECT DISTINCT {B.sql_strip('text')} AS t FROM documents WHERE doc_id % 2 = 1)
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM a) AS train_texts, (SELECT CAST(count(*) AS BIGINT) FROM b) AS test_texts,
      (SELECT CAST(count(*) AS BIGINT) FROM a JOIN b USING (t)) AS overlap,
      round(CAST(100 AS DOUBLE) * (SELECT count(*) FROM a JOIN b USING (t)) / (SELECT count(*) FROM b), 6) AS pct_of_test""",
)
def text_overlap(spark, sf):
    """The two halves of the corpus (even and odd ids) play the train and the test part."""
    docs = texts(spark, sf)
    out = quality.text_overlap(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))
    return out.withColumn("pct_of_test", F.round("pct_of_test", 6))


@query(
    "benchmark_overlap",
    f"""WITH a AS (SELECT DISTINCT {B.sql_strip('text')} AS t FROM documents),
    b AS (SELECT DISTINCT {B.sql_strip('text')} AS t FROM benchmark)
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM a) AS train_texts, (SELECT CAST(count(*) AS BIGINT) FROM b) AS test_texts,
      (SELECT CAST(count(*) AS BIGINT) FROM a JOIN b USING (t)) AS overlap,
      round(CAST(100 AS DOUBLE) * (SELECT count(*) FROM a JOIN b USING (t)) / (SELECT count(*) FROM b), 6) AS pct_of_test""",
)
def benchmark_overlap(spark, sf):
    out = quality.text_overlap(texts(spark, sf), table(spark, sf, "benchmark"))
    return out.withColumn("pct_of_test", F.round("pct_of_test", 6))


@query(
    "sample_n",
    f"SELECT doc_id, lang FROM documents ORDER BY {B.sql_key('doc_id')} LIMIT 250",
)
def sample_n(spark, sf):
    return sampling.sample_n(table(spark, sf, "documents").select("doc_id", "lang"), 250)


@query(
    "train_test_split",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {B.sql_key('doc_id')})
      <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def train_test_split(spark, sf):
    return sampling.train_test_split(table(spark, sf, "documents").select("doc_id"), 0.2)


@query(
    "stratified_split",
    f"""SELECT doc_id, toxic, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY {B.sql_key('doc_id')})
      <= ceil(count(*) OVER (PARTITION BY toxic) * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM labels""",
)
def stratified_split(spark, sf):
    return sampling.train_test_split(table(spark, sf, "labels").select("doc_id", "toxic"), 0.2, stratify="toxic")


@query(
    "kfold",
    f"""WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {B.sql_key('doc_id')}) AS rn,
      count(*) OVER (PARTITION BY toxic) AS n FROM labels)
    SELECT doc_id, toxic, CAST(len(list_filter(range(1, 5), lambda f: rn > f * (n // 5) + least(f, n % 5))) AS INTEGER) AS fold FROM r""",
)
def kfold(spark, sf):
    return sampling.assign_folds(table(spark, sf, "labels").select("doc_id", "toxic"), 5, "toxic")


@query(
    "label_join",
    "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def label_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id")


@query("length_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 3 AND 10000")
def length_filter(spark, sf):
    return quality.length_between(table(spark, sf, "documents")).select("doc_id", "n_chars")


@query(
    "min_length_filter",
    "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND length(text) >= 5",
)
def min_length_filter(spark, sf):
    conv = quality.drop_nulls(table(spark, sf, "conversations"), ["text", "role"])
    return quality.min_length(conv).select("conv_id", "turn")


@query(
    "search_filter",
    "SELECT d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0 AND regexp_matches(d.text, '(?i)the[a-z]+\\s+(in|on)')",
)
def search_filter(spark, sf):
    return quality.search(B.labelled(spark, sf), r"the[a-z]+\s+(in|on)", label=0).select("doc_id", "lang")


@query(
    "merge_datasets",
    """SELECT text, role AS origin FROM conversations UNION ALL SELECT text, 'benchmark' FROM benchmark
    UNION ALL SELECT text, lang FROM documents""",
)
def merge_datasets(spark, sf):
    return quality.merge_datasets(
        [
            table(spark, sf, "conversations").select("text", F.col("role").alias("origin")),
            table(spark, sf, "benchmark").select("text", F.lit("benchmark").alias("origin")),
            table(spark, sf, "documents").select("text", F.col("lang").alias("origin")),
        ]
    )
