"""Bag of words, TF-IDF and pluggable encoders.

Fitting is one aggregation over words and one over the n-grams of frequent words (map-side combined); its
result, a bounded number of terms, is the only thing on the driver. Transforming is a chain of built-in stages applied row by
row, so it needs no shuffle and keeps vectors sparse.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textguard.errors import UnknownMethodError
from textguard.functions.patterns import WORD_CHAR
from textguard.functions.stopwords import resolve_stop_words
from textguard.functions.text import ngram_range
from textguard.functions.vectors import classify_logits, l2_normalize
from textguard.session import write_through

TERMS = "_terms"


def vocabulary(
    docs: DataFrame,
    terms: str = TERMS,
    min_df: int = 2,
    max_df: float = 0.95,
    max_features: int | None = None,
) -> DataFrame:
    """(term, df, tot, n_docs) of an array column; the ``max_features`` most frequent, ties by term.

    Occurrences and first occurrences of a document are counted in one grouping by term, without
    regrouping by (document, term).
    """
    kept = _kept(_counts(docs, terms), docs, min_df, max_df)
    return kept if max_features is None else kept.orderBy(F.desc("tot"), "term").limit(max_features)


def _counts(docs: DataFrame, terms: str) -> DataFrame:
    marks = F.concat(
        F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0).alias("new"))),
        F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(1).alias("new"))),
    )
    return (
        docs.select(F.explode(marks).alias("m"))
        .groupBy(F.col("m.term").alias("term"))
        .agg(F.sum(F.col("m.new").cast("long")).alias("df"), F.sum((1 - F.col("m.new")).cast("long")).alias("tot"))
    )


def _kept(counts: DataFrame, docs: DataFrame, min_df: int, max_df: float) -> DataFrame:
    n_docs = docs.agg(F.count("*")).scalar()
    return counts.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n_docs)).withColumn("n_docs", n_docs)


def frequent_ngrams(docs: DataFrame, terms: str, longest: int, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """The documents of single words ``terms`` with all n-grams that can be among the ``max_features`` most frequent.

    An n-gram occurs no more often than its rarest word. So where ``max_features`` kept words occur at least ``least`` times,
    n-grams with a word below that cannot displace them and need no counting. Without such a bound all n-grams are there.
    """
    counts = write_through(_counts(docs, terms))
    top = _kept(counts, docs, min_df, max_df).orderBy(F.desc("tot")).limit(max_features).agg(F.count("*").alias("n"), F.min("tot").alias("least")).first()
    words = F.col(terms)
    if top["n"] == max_features:
        limit = 2 * max_features + 1000
        frequent = [r["term"] for r in counts.where(F.col("tot") >= top["least"]).select("term").limit(limit + 1).collect()]
        if len(frequent) <= limit:
            words = F.transform(terms, lambda t: F.when(t.isin(frequent), t))
    grams = docs.select(words.alias(terms)).select(ngram_range(F.col(terms), 1, longest).alias(terms))
    return grams.select(F.filter(terms, lambda t: t.isNotNull()).alias(terms))


def terms_sql(text_col: str, stop_words: Sequence[str], ngram: tuple[int, int], min_chars: int = 2) -> str:
    """Statement of the term-extraction stage (a stage made of SQL is stored with the model)."""
    tokens = f"regexp_extract_all(lower(`{text_col}`), r'{WORD_CHAR}{{{min_chars},}}', 0)"
    if stop_words:
        listed = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words)
        tokens = f"filter({tokens}, t -> t NOT IN ({listed}))"
    parts = []
    for n in range(ngram[0], ngram[1] + 1):
        length = f"greatest(size(_tok) - {n - 1}, 0)"
        gram = f"slice(_tok, 1, {length})"
        for shift in range(1, n):
            gram = f"zip_with({gram}, slice(_tok, {shift + 1}, {length}), (a, b) -> concat(a, ' ', b))"
        parts.append("_tok" if n == 1 else gram)
    return (
        f"SELECT * EXCEPT (_tok), concat({', '.join(parts)}) AS {TERMS} "
        f"FROM (SELECT *, coalesce({tokens}, array()) AS _tok FROM __THIS__)"
    )


class TextVectorizer(Estimator):
    """Estimator for ``bow`` and ``tfidf``; the fitted model is a pipeline of built-in stages.

    tf-idf weighs a term by ``ln((1 + N) / (1 + df)) + 1`` and scales rows to unit length. Columns
    are the kept terms in alphabetical order.
    """

    def __init__(
        self,
        method: str = "tfidf",
        text_col: str = "text",
        output: str = "features",
        max_features: int = 5000,
        ngram: tuple[int, int] = (1, 2),
        stop_words: str | Sequence[str] | None = "english",
        min_df: int = 2,
        max_df: float = 0.95,
    ):
        super().__init__()
        if method not in ("bow", "tfidf"):
            raise UnknownMethodError(method)
        self.method, self.text_col, self.output = method, text_col, output
        self.max_features, self.ngram, self.min_df, self.max_df = max_features, ngram, min_df, max_df
        self.stop_words = stop_words

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        words = resolve_stop_words(self.stop_words)
        extract = SQLTransformer(statement=terms_sql(self.text_col, words, self.ngram))
        if self.ngram[0] == 1 and self.ngram[1] > 1 and self.max_features:
            single = SQLTransformer(statement=terms_sql(self.text_col, words, (1, 1))).transform(dataset.select(self.text_col)).select(TERMS)
            docs = frequent_ngrams(single, TERMS, self.ngram[1], self.min_df, self.max_df, self.max_features)
        else:
            docs = extract.transform(dataset.select(self.text_col)).select(TERMS)
        found = vocabulary(docs, TERMS, self.min_df, self.max_df, self.max_features).collect()
        if not found:
            raise ValueError("no term passes min_df and max_df")
        kept = sorted(found, key=lambda r: r["term"])
        terms = [r["term"] for r in kept]
        last = self.output if self.method == "bow" else "_counts"
        counts = CountVectorizerModel.from_vocabulary(terms, inputCol=TERMS, outputCol=last)
        stages = [extract, counts]
        drop = [TERMS]
        if self.method == "tfidf":
            n = found[0]["n_docs"]
            idf = [float(np.log((1.0 + n) / (1.0 + r["df"])) + 1.0) for r in kept]
            stages += [
                ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_weighted"),
                Normalizer(p=2.0, inputCol="_weighted", outputCol=self.output),
            ]
            drop += ["_counts", "_weighted"]
        stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(drop)}) FROM __THIS__"))
        return PipelineModel(stages)


def terms_of(model: PipelineModel) -> list[str]:
    """Vocabulary of a fitted vectorizer, in column order (the vectorizer may be nested)."""
    for stage in model.stages:
        if isinstance(stage, CountVectorizerModel):
            return list(stage.vocabulary)
        if isinstance(stage, PipelineModel):
            nested = terms_of(stage)
            if nested:
                return nested
    return []


def vectors_long(df: DataFrame, terms: Sequence[str], vector: str = "features", id_col: str = "doc_id") -> DataFrame:
    """Vectors as (id, term, value), sparse ones by their stored cells; ``terms`` (at most the feature limit) is broadcast."""
    cell = F.unwrap_udt(vector)
    n = F.size(cell["values"])
    places = F.coalesce(cell["indices"], F.slice(F.sequence(F.lit(0), n), F.lit(1), n))
    cells = df.select(id_col, F.explode(F.arrays_zip(places.alias("i"), cell["values"].alias("x"))).alias("c"))
    names = df.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")
    return cells.select(id_col, F.col("c.i").alias("i"), F.col("c.x").alias("value")).join(F.broadcast(names), "i").drop("i")


# --- sentence encoders -----------------------------------------------------------------------------


def embed_batch(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable],
    text_col: str = "text",
    output: str = "vector",
    batch_size: int = 128,
    normalize: bool = True,
) -> DataFrame:
    """Vectors from a user-supplied encoder, loaded once per Python worker and fed in batches.

    ``make_predict_fn()`` returns a function from an array of texts to a float matrix.
    """
    encode = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    vector = encode(F.coalesce(F.col(text_col), F.lit("")))
    out = df.withColumn(output, vector)
    return out.withColumn(output, l2_normalize(output)) if normalize else out


def classify_batch(
    df: DataFrame, make_predict_fn: Callable[[], Callable], text_col: str = "text", batch_size: int = 32
) -> DataFrame:
    """Add pred, confidence and probs from a user-supplied sequence classifier that returns raw scores."""
    scores = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    out = df.withColumn("_logits", scores(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.withColumn("_c", classify_logits("_logits"))
    return out.select(
        *df.columns, F.col("_c.label").alias("pred"), F.col("_c.confidence").alias("confidence"), F.col("_c.probs").alias("probs")
    )


def hashing_encoder(size: int = 64) -> Callable[[], Callable]:
    """A stand-in encoder without weights: signed feature hashing of lower-case word pieces."""

    def make():
        import zlib

        def encode(texts):
            out = np.zeros((len(texts), size), dtype="float32")
            for row, value in enumerate(texts):
                for piece in str(value).lower().split():
                    code = zlib.crc32(piece.encode("utf-8"))
                    out[row, code % size] += 1.0 if (code >> 16) & 1 else -1.0
            return out

        return encode

    return make
