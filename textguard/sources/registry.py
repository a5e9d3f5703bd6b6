"""Fitted pipelines on storage plus a registry table with their metadata."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = (
    "model_id string, name string, embedding string, dataset string, accuracy double, precision double, "
    "recall double, f1 double, timestamp string, model_path string, extra string"
)
_KNOWN = ("embedding", "dataset", "accuracy", "precision", "recall", "f1")


def save_model(spark: SparkSession, model: PipelineModel, root: str, name: str, metadata: dict | None = None) -> str:
    """Store features and classifier together and append the registry row; returns the model id."""
    meta = dict(metadata or {})
    now = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    model_id = f"{name}_{now}"
    path = f"{root}/models/{model_id}"
    model.write().overwrite().save(path)
    known = {k: meta.pop(k, None) for k in _KNOWN}
    for metric in ("accuracy", "precision", "recall", "f1"):
        known[metric] = None if known[metric] is None else float(known[metric])
    row = {"model_id": model_id, "name": name, "timestamp": now, "model_path": path, **known}
    row["extra"] = json.dumps(meta, sort_keys=True, default=str)
    names = [f.split()[0] for f in REGISTRY_SCHEMA.split(", ")]
    spark.createDataFrame([tuple(row[n] for n in names)], REGISTRY_SCHEMA).write.mode("append").parquet(
        f"{root}/registry"
    )
    return model_id


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/registry")
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY_SCHEMA)


def load_model(spark: SparkSession, root: str, model_id: str | None = None) -> PipelineModel | None:
    """The named model (an unknown id is an error), or the newest one; ``None`` if there is none."""
    rows = read_registry(spark, root)
    if model_id is not None:
        rows = rows.where(F.col("model_id") == model_id)
    found = rows.orderBy(F.desc("timestamp")).limit(1).collect()
    if not found:
        if model_id is not None:
            raise ValueError(f"model {model_id} is not registered")
        return None
    return PipelineModel.load(found[0]["model_path"])
