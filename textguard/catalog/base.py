"""Query registry, table access and the SQL fragments the oracle queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import patterns as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The short stop list used by the registered queries and their SQL.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "was", "that", "it", "for", "with", "as", "by", "on", "at")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the cluster has slots; otherwise leave it.

    A small file is one split and would be worked on by one task. Large inputs already have enough
    splits and are not shuffled.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= slots:
        return scan
    return scan.repartition(slots, *keys)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled corpus: documents joined to labels, ``type`` = toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("type"))
    return texts(spark, sf_dir).join(labels, "doc_id")


# --- SQL fragments -----------------------------------------------------------------------------

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def sql_replace(expr: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', '{flags}')"


def sql_count(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, '{pattern}')) AS INTEGER)"


def sql_stats(expr: str, prefix: str = "text") -> str:
    return ", ".join(
        [
            f"{sql_count(expr, P.PIECE)} AS {prefix}_words",
            f"CAST(length({expr}) AS INTEGER) AS {prefix}_chars",
            f"{sql_count(expr, P.MENTION)} AS {prefix}_mentions",
            f"{sql_count(expr, P.HASHTAG)} AS {prefix}_hashtags",
            f"{sql_count(expr, P.URL)} AS {prefix}_urls",
            f"{sql_count(expr, P.CAPITAL)} AS {prefix}_capitals",
        ]
    )


def sql_clean(expr: str, keep: bool = False) -> str:
    t = sql_replace(expr, P.TAG, "")
    t = sql_replace(t, P.URL, "")
    t = sql_replace(t, P.MENTION, " @USER " if keep else "")
    t = sql_replace(t, P.HASHTAG, " #HASHTAG " if keep else "")
    t = sql_replace(t, P.EMOJI, "")
    t = sql_replace(t, r"\bRT\b", "", "gi")
    t = sql_replace(t, P.NOT_ALNUM, " ")
    t = sql_replace(t, P.SPACES, " ")
    return f"trim(lower({t}))"


def sql_light(expr: str) -> str:
    """Light cleaning with URLs, mentions, case and spaces handled, hashtags kept, no NFKC."""
    t = sql_replace(expr, P.URL, "", "gi")
    t = sql_replace(t, P.MENTION_WORD, "")
    t = sql_replace(f"lower({t})", P.SPACES, " ")
    return sql_replace(t, "^ | $", "")


def sql_strip(expr: str) -> str:
    return sql_replace(expr, P.EDGE_SPACES, "")


def sql_tokens(expr: str, pattern: str = P.TOKEN_2PLUS) -> str:
    return f"list_filter(regexp_extract_all(lower({expr}), '{pattern}'), lambda x: x NOT IN {STOP_SQL})"


def sql_key(expr: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {expr})"


LABELLED_SQL = "SELECT d.*, l.toxic AS type FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
