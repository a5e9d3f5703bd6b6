"""Schema detection, label normalisation and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textguard.catalog import base as B
from textguard.catalog.base import query, table
from textguard.operators import quality, validate
from textguard.sources import normalise, readers, writers
from textguard.sources import schema as S

# Named classes as an annotated corpus has them, derived from labels and the document's source.
_CLASS = "CASE WHEN toxic = 0 THEN ' Not_Cyberbullying' WHEN doc_id % 3 = 0 THEN 'religion' WHEN doc_id % 3 = 1 THEN 'age ' ELSE 'gender' END"


@query(
    "detect_text_profile",
    """SELECT 'text' AS "column", coalesce(max(length(text)) > 3, false) AS usable FROM documents
    UNION ALL SELECT 'content', coalesce(max(length(source)) > 3, false) FROM documents
    UNION ALL SELECT 'message', coalesce(max(length(lang)) > 3, false) FROM documents""",
)
def detect_text_profile(spark, sf):
    docs = table(spark, sf, "documents").select("text", F.col("source").alias("content"), F.col("lang").alias("message"))
    return S.text_profile(docs)


@query(
    "detect_label_profile",
    f"""SELECT coalesce(bool_and(toxic IN (0, 1)), true) AS type_binary,
    coalesce(bool_or(lower(trim({_CLASS})) IN ('not_cyberbullying', '0')), false) AS label_named,
    coalesce(bool_or(lower(trim({_CLASS})) IN ('not_sarcasm', 'sarcasm')), false) AS label_sarcasm FROM labels""",
)
def detect_label_profile(spark, sf):
    labels = table(spark, sf, "labels")
    return S.label_profile(labels.select(F.col("toxic").alias("type"), F.expr(_CLASS).alias("label")))


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS position, {str(t).lower()} AS is_text,
        {f'round(avg(length({c})), 6)' if t else 'CAST(NULL AS DOUBLE)'} AS mean_chars, count(DISTINCT {c}) <= 10 AS few_values FROM documents"""
        for i, (c, t) in enumerate([("doc_id", False), ("text", True), ("lang", True), ("source", True), ("n_chars", False)])
    ),
)
def column_profile(spark, sf):
    return S.column_profile(table(spark, sf, "documents")).withColumn("mean_chars", F.round("mean_chars", 6))


@query(
    "binary_named",
    f"SELECT doc_id, CASE WHEN lower(trim({_CLASS})) IN ('not_cyberbullying', '0') THEN 0 ELSE 1 END AS type FROM labels",
)
def binary_named(spark, sf):
    labels = table(spark, sf, "labels").withColumn("label", F.expr(_CLASS))
    return labels.select("doc_id", S.to_binary("label", (S.NOT_ABUSIVE, "0")).alias("type"))


@query(
    "binary_auto",
    f"""SELECT doc_id, CASE WHEN (SELECT bool_and(trim(CAST(toxic AS VARCHAR)) IN ('0', '1')) FROM labels) THEN toxic ELSE 1 END AS type,
    CASE WHEN lower(trim({_CLASS})) = 'not_cyberbullying' THEN 0 ELSE 1 END AS type_named FROM labels""",
)
def binary_auto(spark, sf):
    labels = table(spark, sf, "labels").withColumns(
        {"numbers": F.col("toxic").cast("string"), "names": F.expr(_CLASS)}
    )
    return labels.select(
        "doc_id",
        S.to_binary_auto(labels, "numbers").alias("type"),
        S.to_binary_auto(labels, "names").alias("type_named"),
    )


@query(
    "binary_not",
    "SELECT doc_id, CASE WHEN quality IS NOT DISTINCT FROM 0 THEN 0 ELSE 1 END AS type FROM labels",
)
def binary_not(spark, sf):
    return table(spark, sf, "labels").select("doc_id", S.to_binary_not("quality", 0).alias("type"))


@query(
    "sarcasm_rule",
    """SELECT doc_id, CASE WHEN upper(trim(CASE WHEN doc_id % 3 = 0 THEN ' sarcasm' WHEN doc_id % 3 = 1 THEN 'NOT_SARCASM' ELSE lang END)) = 'SARCASM'
      THEN 1 ELSE 0 END AS type FROM documents WHERE length(text) >= 5 AND lang IS NOT NULL""",
)
def sarcasm_rule(spark, sf):
    raw = F.expr("CASE WHEN doc_id % 3 = 0 THEN ' sarcasm' WHEN doc_id % 3 = 1 THEN 'NOT_SARCASM' ELSE lang END")
    docs = quality.min_length(table(spark, sf, "documents").withColumn("label", raw).dropna(subset=["text", "label"]))
    return docs.select("doc_id", S.sarcasm_rule("label").alias("type"))


_VOTES = "list_transform(embedding, lambda x: CAST(abs(CAST(floor(x * CAST(10 AS DOUBLE)) AS BIGINT)) % 3 AS INTEGER))"


@query(
    "majority_label",
    f"""WITH v AS (SELECT vec_id, unnest({_VOTES}) AS vote, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    c AS (SELECT vec_id, vote, count(*) AS n, min(pos) AS first FROM v GROUP BY vec_id, vote),
    m AS (SELECT vec_id, first(vote ORDER BY n DESC, first) AS vote FROM c GROUP BY vec_id)
    SELECT vec_id, vote AS majority, CASE WHEN vote = 2 THEN 0 ELSE 1 END AS type FROM m""",
)
def majority_label(spark, sf):
    """The components of a vector, folded to 0..2, play the annotators' votes."""
    votes = F.transform(
        "embedding",
        lambda x: (F.abs(F.floor(x.cast("double") * F.lit(10.0)).cast("long")) % 3).cast("int"),
    )
    vecs = table(spark, sf, "embeddings").select("vec_id", votes.alias("votes"))
    return vecs.select("vec_id", S.majority("votes").alias("majority"), S.majority_label("votes").alias("type"))


@query(
    "majority_by_group",
    """SELECT user_id, first(event_type ORDER BY n DESC, f) AS majority FROM
    (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id""",
)
def majority_by_group(spark, sf):
    return S.majority_by_group(table(spark, sf, "events"), "user_id", "event_type", "event_id")


@query(
    "normalise_sources",
    f"""SELECT 'named' AS source, 'train' AS split, d.doc_id % 2 = 0 AS even, CAST(count(*) AS BIGINT) AS n,
      CAST(sum(CASE WHEN lower(trim(c.label)) = 'not_cyberbullying' THEN 0 ELSE 1 END) AS BIGINT) AS positive, CAST(sum(length(d.text)) AS BIGINT) AS chars
      FROM documents d JOIN (SELECT doc_id, {_CLASS} AS label FROM labels) c USING (doc_id) WHERE length(d.text) >= 5 GROUP BY ALL
    UNION ALL SELECT 'comments', 'train', NULL, count(*), CAST(sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT), CAST(sum(length(text)) AS BIGINT)
      FROM conversations WHERE length(text) >= 5
    UNION ALL SELECT 'annotated', 'test', NULL, count(*), CAST(sum(CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 1 END) AS BIGINT),
      CAST(sum(length(text)) AS BIGINT) FROM documents WHERE length(text) >= 5""",
)
def normalise_sources(spark, sf):
    """Three source shapes unified, then counted per source and split."""
    labels = table(spark, sf, "labels").select("doc_id", F.expr(_CLASS).alias("label"))
    named = table(spark, sf, "documents").join(labels, "doc_id")
    comments = table(spark, sf, "conversations").select(
        F.col("text").alias("comment_text"), (F.col("turn") % 3).alias("label")
    )
    annotated = table(spark, sf, "documents").select(
        F.split("text", " ").alias("post_tokens"),
        F.struct(F.array((F.col("doc_id") % 3).cast("int"), F.lit(None).cast("int")).alias("label")).alias("annotators"),
    )
    annotated = annotated.withColumn(
        "annotators", F.struct(F.filter("annotators.label", lambda x: x.isNotNull()).alias("label"))
    )
    out = normalise.normalise_sources(
        {
            "named_even": ("auto", {"train": named.where("doc_id % 2 = 0")}),
            "named_odd": ("auto", {"train": named.where("doc_id % 2 = 1")}),
            "comments": ("comments", {"train": comments}),
            "annotated": ("annotated", {"test": annotated}),
        }
    )
    even = F.when(F.col("source") == "named_even", True).when(F.col("source") == "named_odd", False)
    return out.groupBy(
        F.regexp_replace("source", "_(even|odd)$", "").alias("source"), "split", even.alias("even")
    ).agg(F.count("*").alias("n"), F.sum("type").alias("positive"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    "corpus_fingerprint",
    """WITH h AS (SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || text), 1, 8) AS BIGINT) AS v FROM documents)
    SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(sum(v) AS BIGINT) AS digest_sum, bit_xor(v) AS digest_xor FROM h""",
)
def corpus_fingerprint(spark, sf):
    return writers.corpus_fingerprint(table(spark, sf, "documents"))


@query(
    "prepare_corpus",
    f"""WITH u AS (SELECT d.doc_id AS id, d.text, l.toxic AS type, 'documents' AS source FROM documents d JOIN labels l USING (doc_id)
      WHERE d.text IS NOT NULL AND l.toxic IS NOT NULL
      UNION ALL SELECT conv_id * 1000 + turn, text, CASE WHEN role = 'user' THEN 1 ELSE 0 END, 'conversations' FROM conversations),
    k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source DESC, id) AS rn FROM u)
    SELECT source, type, CAST(count(*) AS BIGINT) AS n, CAST(sum(length({B.sql_light('text')})) AS BIGINT) AS chars
    FROM k WHERE rn = 1 AND length(text) BETWEEN 3 AND 10000 GROUP BY source, type""",
)
def prepare_corpus(spark, sf):
    """Two raw sources detected, unified, deduplicated, bounded and cleaned; counted per source."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("type"))
    conv = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row"),
        F.col("text").alias("content"), F.when(F.col("role") == "user", "age").otherwise(S.NOT_ABUSIVE).alias("label")
    )
    merged = quality.merge_datasets(
        [
            readers.normalise_labelled(docs, source="documents", ordinal=0, id_col="doc_id"),
            readers.normalise_labelled(conv, source="conversations", ordinal=1, id_col="row"),
        ]
    )
    config = {**validate.DEFAULT_VALIDATION, "cleaning": {**validate.DEFAULT_VALIDATION["cleaning"], "fix_unicode": False}}
    clean = validate.validate_and_preprocess(merged, config)
    return clean.groupBy("source", "type").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars")
    )
