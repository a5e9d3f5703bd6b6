"""Vectorisation queries."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textguard.catalog import base as B
from textguard.catalog.base import query, table, texts
from textguard.functions import text as T
from textguard.functions.vectors import classify_logits
from textguard.operators import aggregate_vectors as A
from textguard.operators import cooccurrence as C
from textguard.operators import vectorize as V
from textguard.operators.cbow import train_cbow, word_counts
from textguard.operators.word_models import EncoderModel
from textguard.session import shared_folder
from textguard.sources.embedding_store import EmbeddingStore

N_FEATURES = 500

_TERMS_SQL = f"""tok AS (SELECT doc_id, {B.sql_tokens('text')} AS t FROM documents),
  terms AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
  v AS (SELECT term, count(*) AS df, sum(tf) AS tot FROM tf GROUP BY term
    HAVING count(*) >= 2 AND count(*) <= CAST(0.95 AS DOUBLE) * (SELECT count(*) FROM documents) ORDER BY tot DESC, term LIMIT {N_FEATURES})"""
_WEIGHTS_SQL = """SELECT {id}, term, CAST(tf AS DOUBLE) * (ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM documents)) / (CAST(1 AS DOUBLE) + df)) + CAST(1 AS DOUBLE)) AS x
  FROM {tf} JOIN v USING (term)"""


def _vectorizer(method: str) -> V.TextVectorizer:
    return V.TextVectorizer(method, max_features=N_FEATURES, stop_words=B.STOP_WORDS)


@query("bow_long", f"WITH {_TERMS_SQL} SELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM tf JOIN v USING (term)")
def bow_long(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text")
    model = _vectorizer("bow").fit(docs)
    out = V.vectors_long(model.transform(docs), V.terms_of(model))
    return out.select("doc_id", "term", F.col("value").cast("long").alias("tf"))


@query(
    "tfidf_long",
    f"""WITH {_TERMS_SQL}, w AS ({_WEIGHTS_SQL.format(id='doc_id', tf='tf')})
    SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
)
def tfidf_long(spark, sf):
    docs = texts(spark, sf).select("doc_id", "text")
    model = _vectorizer("tfidf").fit(docs)
    out = V.vectors_long(model.transform(docs), V.terms_of(model))
    return out.select("doc_id", "term", F.round("value", 6).alias("weight"))


@query(
    "tfidf_unseen",
    f"""WITH {_TERMS_SQL}, btok AS (SELECT item_id, {B.sql_tokens('text')} AS t FROM benchmark),
    bterms AS (SELECT item_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM btok),
    btf AS (SELECT item_id, term, count(*) AS tf FROM bterms GROUP BY ALL), w AS ({_WEIGHTS_SQL.format(id='item_id', tf='btf')})
    SELECT item_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS weight FROM w""",
)
def tfidf_unseen(spark, sf):
    """Vocabulary and weights of the corpus applied to the held-out benchmark texts."""
    model = _vectorizer("tfidf").fit(texts(spark, sf).select("doc_id", "text"))
    out = V.vectors_long(model.transform(table(spark, sf, "benchmark")), V.terms_of(model), id_col="item_id")
    return out.select("item_id", "term", F.round("value", 6).alias("weight"))


@query(
    "cooccurrence",
    f"""WITH tok AS (SELECT doc_id, {B.sql_tokens('text', B.P.TOKEN_1PLUS)} AS t FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
    v AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= CAST(0.95 AS DOUBLE) * (SELECT count(*) FROM documents)),
    k AS (SELECT tf.* FROM tf JOIN v USING (term)),
    p AS (SELECT a.term AS w1, b.term AS w2, sum(a.n * b.n) AS x FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.term <> b.term GROUP BY ALL)
    SELECT w1, CAST(count(*) AS BIGINT) AS neighbours, CAST(sum(x) AS BIGINT) AS total, CAST(max(x) AS BIGINT) AS strongest FROM p GROUP BY w1""",
)
def cooccurrence(spark, sf):
    """Whole co-occurrence matrix, reported per word."""
    cells = C.cooccurrence(texts(spark, sf).select("doc_id", "text"), stop_words=B.STOP_WORDS)
    return cells.groupBy("w1").agg(
        F.count("*").alias("neighbours"), F.sum("x").alias("total"), F.max("x").alias("strongest")
    )


@query(
    "token_vector_lookup",
    f"""WITH w AS (SELECT 'w' || vec_id AS word, embedding AS e FROM embeddings),
    t AS (SELECT doc_id, 'w' || CAST(unnest(list_transform(regexp_extract_all(lower(text), '{B.P.PIECE}'), lambda x: len(x) * 7)) AS VARCHAR) AS word FROM documents),
    j AS (SELECT doc_id, e FROM t JOIN w USING (word))
    SELECT d.doc_id, CAST(count(j.e) AS BIGINT) AS known, round(coalesce(avg(CAST(e[1] AS DOUBLE)), 0), 5) AS m1,
      round(coalesce(max(CAST(e[64] AS DOUBLE)), 0), 5) AS x64 FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY d.doc_id""",
)
def token_vector_lookup(spark, sf):
    """A token of n characters is looked up as word ``w(7n)``; unknown words are skipped."""
    words = table(spark, sf, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vector")
    )
    pieces = T.split_words("text", lowercase=True)
    docs = texts(spark, sf).select(
        "doc_id",
        F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("w"), (F.length(p) * 7).cast("string"))), " ").alias("text"),
    )
    mean = A.document_vectors(docs, words, "mean", output="mean")
    both = A.document_vectors(mean, words, "max", output="max")
    known = words.select("word", F.lit(1).alias("hit"))
    hits = (
        docs.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
        .groupBy("doc_id", "word")
        .agg(F.count("*").alias("n"))
        .join(known, "word")
        .groupBy("doc_id")
        .agg(F.sum("n").alias("known"))
    )
    return both.join(hits, "doc_id", "left").select(
        "doc_id",
        F.coalesce("known", F.lit(0)).alias("known"),
        F.round(F.col("mean")[0], 5).alias("m1"),
        F.round(F.col("max")[63], 5).alias("x64"),
    )


_LONG_VECTORS = "SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
_AGG_SQL = {
    "mean": "avg(x)",
    "sum": "sum(x)",
    "max": "max(x)",
    "min": "min(x)",
    "median": "median(x)",
    "mean_top_3": "list_avg(list_sort(list(x), 'DESC')[1:3])",
}


def _register_aggregations() -> None:
    for method, expr in _AGG_SQL.items():

        def run(spark, sf, method=method):
            vecs = table(spark, sf, "embeddings")
            return A.aggregate_by(vecs, ["label"], "embedding", method).withColumn("value", F.round("value", 6))

        sql = f"SELECT label, CAST(dim AS INTEGER) AS dim, round({expr}, 6) AS value FROM ({_LONG_VECTORS}) GROUP BY label, dim"
        query(f"vector_agg_{method}", sql)(run)


_register_aggregations()


@query(
    "softmax_argmax",
    """WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
    e AS (SELECT vec_id, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z)
    SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS label, round(1 / list_sum(e), 6) AS confidence,
      round(e[1] / list_sum(e), 6) AS p0 FROM e""",
)
def softmax_argmax(spark, sf):
    c = table(spark, sf, "embeddings").select("vec_id", classify_logits("embedding").alias("c"))
    return c.select(
        "vec_id",
        F.col("c.label").alias("label"),
        F.round("c.confidence", 6).alias("confidence"),
        F.round(F.col("c.probs")[0], 6).alias("p0"),
    )


_PIECES = f"unnest(regexp_extract_all(text, '{B.P.PIECE}'))"
_VOCABULARY_SQL = f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_PIECES} AS word FROM documents) GROUP BY word HAVING count(*) >= 2"


@query("word2vec_vocabulary", _VOCABULARY_SQL)
def word2vec_vocabulary(spark, sf):
    return word_counts(texts(spark, sf))


@query(
    "word2vec_docs",
    f"""WITH v AS ({_VOCABULARY_SQL}), p AS (SELECT doc_id, lower(word) AS word FROM (SELECT doc_id, {_PIECES} AS word FROM documents)),
    k AS (SELECT doc_id, count(*) AS n FROM p JOIN v USING (word) GROUP BY doc_id)
    SELECT doc_id, 100 AS dims, k.n IS NULL AS is_zero, TRUE AS is_finite FROM documents LEFT JOIN k USING (doc_id)""",
)
def word2vec_docs(spark, sf):
    """Vectors trained on all documents at the defaults: every text with a known word has one, the others are zero."""
    docs = texts(spark, sf).select("doc_id", "text")
    out = A.document_vectors(docs, train_cbow(docs))
    return out.select(
        "doc_id", F.size("vector").alias("dims"), F.forall("vector", lambda x: x == 0).alias("is_zero"),
        F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < 1e3)).alias("is_finite"),
    )


@query(
    "glove_train",
    f"""WITH tf AS (SELECT DISTINCT item_id, unnest({B.sql_tokens('text', B.P.TOKEN_1PLUS)}) AS term FROM benchmark),
    v AS (SELECT term FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= CAST(0.95 AS DOUBLE) * (SELECT count(*) FROM benchmark)),
    k AS (SELECT tf.* FROM tf JOIN v USING (term))
    SELECT DISTINCT a.term AS word, 8 AS dims FROM k a JOIN k b ON a.item_id = b.item_id AND a.term <> b.term""",
)
def glove_train(spark, sf):
    cells = C.cooccurrence(table(spark, sf, "benchmark"), id_col="item_id", stop_words=B.STOP_WORDS)
    return C.train_glove(cells, size=8, sweeps=2).select("word", F.size("vector").alias("dims"))


@query("embed_batch", "SELECT doc_id, 32 AS dims, TRUE AS is_unit FROM documents")
def embed_batch(spark, sf):
    out = V.embed_batch(texts(spark, sf).select("doc_id", "text"), V.hashing_encoder(32))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return out.select("doc_id", F.size("vector").alias("dims"), ((norm == 0) | (F.abs(norm - 1) < 1e-5)).alias("is_unit"))


@query(
    "cached_embedding",
    """SELECT d.doc_id, 32 AS dims, s.computed, TRUE AS same FROM documents d, (SELECT CAST(count(*) AS BIGINT) AS computed FROM
    (SELECT DISTINCT text FROM documents)) s""",
)
def cached_embedding(spark, sf):
    """All documents by a stored encoder after one language was stored first: every different text is computed once."""
    docs = texts(spark, sf).select("doc_id", "lang", "text")
    store, stage = EmbeddingStore(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"), EncoderModel.of(V.hashing_encoder, {"size": 32})
    first = store.add(docs.where("lang = 'en'"), stage)
    out = store.transform(docs, stage)
    computed = store.commits().agg(F.sum("rows")).first()[0] or first
    fresh = stage.transform(docs.select(F.col("doc_id").alias("_id"), F.col("text"))).select("_id", F.col("features").alias("_fresh"))
    both = out.join(fresh, F.col("doc_id") == F.col("_id"))
    mine, theirs = vector_to_array("features"), vector_to_array("_fresh")
    gap = F.aggregate(F.zip_with(mine, theirs, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b)
    return both.select("doc_id", F.size(mine).alias("dims"), F.lit(computed).cast("long").alias("computed"), (gap < 1e-9).alias("same"))
