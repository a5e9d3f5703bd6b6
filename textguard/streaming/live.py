"""Live scoring: the batch functions on an unbounded text stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textguard.functions.hashing import text_digest
from textguard.operators.models import predict
from textguard.operators.validate import apply_feature_engineering


def score_stream(
    stream: DataFrame,
    model: PipelineModel,
    threshold: float = 0.5,
    time_col: str | None = None,
    dedup_within: str = "1 hour",
    dedup: bool = True,
) -> DataFrame:
    """Drop exact repeats, compute statistics, clean, score and decide.

    Repeats are recognised by digest for ``dedup_within`` of event time, so the state holds 32
    bytes per recent text. A source without a time column is stamped on arrival.
    """
    if dedup:
        if time_col is None:
            time_col = "_arrived"
            stream = stream.withColumn(time_col, F.current_timestamp())
        stream = (
            stream.withColumn("_digest", text_digest("text"))
            .withWatermark(time_col, dedup_within)
            .dropDuplicatesWithinWatermark(["_digest"])
            .drop("_digest")
        )
    return predict(apply_feature_engineering(stream, "text"), model, threshold)


def write_scores(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scores as parquet; ``available_now`` works off what is there and stops."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()
