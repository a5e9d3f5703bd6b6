"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm import decontaminate, language_id, ngram_join, packing, suffix_dedup
from textguard.llm.common import WORD, materialise, table, words_of
from textguard.session import write_through

PASSAGE_WORDS = 51  # passages of over 50 words
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: texts without a letter go, and texts that decode worse than
    held-out labelled texts of their length. Without labels there is nothing to compare with: letters decide."""
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    out = language_id.identify(docs, language_id.with_limits(docs, model))
    return out.where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar shingle sets: the first by id, null ids last, and text hash.

    Ids may repeat or be null, so two hashes of id and text name a row; of equal rows with words one stays. Rows
    without a word belong to no group and all stay.
    """
    one, two = suffix_dedup.keys("doc_id", "text")
    keyed = docs.withColumn("_k1", one).withColumn("_k2", two)
    keyed = keyed.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "_k1", "_k2"))
    found = ngram_join.groups(keyed, words=5, percent=80, id_col="_key")
    keep = found.where((F.col("n_shingles") > 0) & (F.col("doc_id") == F.col("component_id"))).select("doc_id._k1", "doc_id._k2").distinct()
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    first = keyed.where(worded).drop("_key").dropDuplicates(["_k1", "_k2"]).join(keep, ["_k1", "_k2"], "left_semi")
    return first.select(*COLUMNS).union(docs.where(~worded).select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of over 50 words or of 400 bytes are cut; a document of which no word is left goes."""
    out = suffix_dedup.strip_copies(docs, PASSAGE_WORDS, words=True).withColumnRenamed("n_removed", "n_words_removed")
    out = suffix_dedup.strip_copies(write_through(out))
    left = out.where((F.col("n_removed") + F.col("n_words_removed") == 0) | (F.size(words_of(F.col("text"))) > 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.annotate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

# The stages' models and tilings are beyond SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
