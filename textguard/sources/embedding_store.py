"""Vectors kept by text: only texts that the store has not seen are computed.

A store holds committed batches. A batch is a folder of (digest, features) rows, written first; a row of the
commit table then names it with its number of rows. A batch without a commit row never happened; a committed
batch whose rows are gone, wholly or in part, is noticed by its count and its texts are computed again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "batch string, rows long"
ROWS = "digest string, vector array<double>"


def text_digest(text_col: str) -> Column:
    """Digest of a text; null texts share one of their own."""
    return F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null"))


@dataclass
class EmbeddingStore:
    """``root`` is a folder for one fitted stage; ``lost`` lists committed batches found incomplete so far."""

    spark: SparkSession
    root: str
    lost: list[str] = field(default_factory=list)

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException:
            return self.spark.createDataFrame([], COMMITS)

    def _batches(self) -> DataFrame:
        """Rows of all batch folders, with the name of each one's folder."""
        name = F.regexp_extract(F.input_file_name(), r"/batch-([0-9a-f]{32})/", 1)
        try:
            return self.spark.read.schema(ROWS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(
                f"{self.root}/batches"
            ).withColumn("batch", name)
        except AnalysisException:
            return self.spark.createDataFrame([], f"{ROWS}, batch string")

    def vectors(self) -> DataFrame:
        """(digest, vector) of the whole batches: those whose rows are as many as their commit says."""
        rows = self._batches()
        found = rows.groupBy("batch").agg(F.count("*").alias("found"))
        state = self.commits().join(found, "batch", "left").withColumn("whole", F.coalesce(F.col("found") == F.col("rows"), F.lit(False)))
        states = state.select("batch", "whole").collect()  # a row per batch
        self.lost = sorted(r["batch"] for r in states if not r["whole"])
        whole = self.spark.createDataFrame([(r["batch"],) for r in states if r["whole"]], "batch string")
        # Batches that overlap hold equal vectors.
        return rows.join(F.broadcast(whole), "batch", "left_semi").groupBy("digest").agg(F.any_value("vector").alias("vector"))

    def add(self, texts: DataFrame, stage: Transformer, text_col: str = "text", features: str = "features") -> int:
        """Compute and commit the vectors of the texts that are not stored; returns how many those were."""
        fresh = texts.select(text_digest(text_col).alias("digest"), F.col(text_col)).groupBy("digest").agg(F.first(text_col).alias(text_col))
        fresh = fresh.join(self.vectors().select("digest"), "digest", "left_anti")
        batch = uuid.uuid4().hex
        path = f"{self.root}/batches/batch-{batch}"
        stage.transform(fresh).select("digest", vector_to_array(features).alias("vector")).write.parquet(path)
        n = self.spark.read.schema(ROWS).parquet(path).count()
        if n:
            self.spark.createDataFrame([(batch, n)], COMMITS).write.mode("append").parquet(f"{self.root}/commits")
        return n

    def transform(self, df: DataFrame, stage: Transformer, text_col: str = "text", features: str = "features") -> DataFrame:
        """The rows with their vectors; unseen texts are added to the store first. Rows and columns are otherwise kept."""
        self.add(df, stage, text_col, features)
        stored = self.vectors().withColumnsRenamed({"digest": "_digest", "vector": "_vector"})
        out = df.withColumn("_own", text_digest(text_col)).join(stored, F.col("_own") == F.col("_digest"))
        return out.withColumn(features, array_to_vector("_vector")).drop("_own", "_digest", "_vector")
