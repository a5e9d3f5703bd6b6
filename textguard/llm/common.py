"""Shared pieces: word arrays, hashing, scratch tables and components of a graph."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.session import shuffle_files_removed

WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="textguard-llm-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return _local[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read to the shared scratch folder, and read it back."""
    path = f"{scratch_root(df.sparkSession)}/textguard-{uuid.uuid4().hex}/{name}"
    with shuffle_files_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(value: Column) -> Column:
    """The value as a generated column: a caller's filter is not pushed below it, where the optimiser
    would put the whole expression into every place, lambdas included, that uses the column."""
    return F.explode(F.array(value))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words between white space; an empty array for null or blank text."""
    return F.coalesce(F.filter(F.split(text, WHITE), lambda w: w != ""), F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    """64-bit hash of every word of a text, in order."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` word hashes; one window of all words if there are fewer."""
    words = words.view(np.uint64)
    if not len(words):
        return words
    n = min(n, len(words))
    size = len(words) - n + 1
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mix(out * GOLDEN + words[k : k + size])
    return out


def list_parts(array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an Arrow list array; null lists are empty."""
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy(zero_copy_only=False)
    return values, offsets


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from every vertex of ``edges(a, b)``: rows ``(id, component_id)``.

    Alternating star contraction: every round links each vertex's larger neighbours, then its smaller
    ones, to the smallest neighbour, so chains shrink geometrically and a hub only sends edges through
    map-side combined minima. Each round is written to shared storage, which cuts the lineage.
    """
    current = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = materialise(
            small.union(small_low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges"
        )
        # Finished once every vertex has one neighbour and no neighbour has a smaller one itself.
        roots = following.select(F.col("b").alias("a"))
        open_edges = following.groupBy("a").count().where("count > 1").limit(1).count()
        if not open_edges and not following.join(roots, "a", "left_semi").limit(1).count():
            return following.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
                following.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
            )
        current = following
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
