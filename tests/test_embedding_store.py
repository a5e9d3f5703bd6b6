"""Incremental vectors: what is computed, committed, lost and found again."""

import glob
import os

import pytest
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textguard.sources.embedding_store import EmbeddingStore


class Counting(Transformer):
    """Length and number of vowels of a text; counts the texts it has been asked for."""

    def __init__(self, counter, fail=False):
        super().__init__()
        self.counter, self.fail = counter, fail

    def _transform(self, dataset):
        counter, fail = self.counter, self.fail

        @F.pandas_udf("array<double>")
        def vector(text):
            if fail:
                raise RuntimeError("no vectors today")
            counter.add(len(text))
            return text.map(lambda t: [float(len(t or "")), float(sum(c in "aeiou" for c in t or ""))])

        return dataset.withColumn("features", array_to_vector(vector("text")))


def docs(spark, ids):
    return spark.createDataFrame([(i, None if i == 3 else f"text number {i % 500}", i % 2) for i in ids], "doc_id long, text string, type int")


def test_only_unseen_texts_are_computed(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)
    store, stage = EmbeddingStore(spark, str(tmp_path / "s")), Counting(counter)
    first = store.transform(docs(spark, range(400)), stage)
    assert first.count() == 400 and counter.value == 400 and first.columns == ["doc_id", "text", "type", "features"]
    again = store.transform(docs(spark, range(404)), stage)  # one hundredth more
    assert {r["doc_id"]: r["features"].toArray().tolist() for r in again.collect()} == {
        i: ([0.0, 0.0] if i == 3 else [float(len(f"text number {i}")), sum(c in "aeiou" for c in "text number ") * 1.0]) for i in range(404)
    }
    assert counter.value == 404
    # Another label or id, and repeated texts, need nothing new.
    assert store.transform(docs(spark, range(504, 900)).withColumn("type", F.lit(7)), stage).count() == 396 and counter.value == 404
    assert sorted(r["rows"] for r in store.commits().collect()) == [4, 400] and store.lost == []


def test_a_lost_file_is_noticed_and_computed_again(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)
    store, stage = EmbeddingStore(spark, str(tmp_path / "s")), Counting(counter)
    store.add(docs(spark, range(100)).repartition(4), stage)
    store.add(docs(spark, range(120)), stage)
    assert counter.value == 120
    batch = min(store.commits().collect(), key=lambda r: -r["rows"])["batch"]
    os.remove(sorted(glob.glob(str(tmp_path / "s" / "batches" / f"batch-{batch}" / "*.parquet")))[0])
    assert store.transform(docs(spark, range(120)), stage).count() == 120
    assert counter.value == 220 and store.lost == [batch]


def test_an_uncommitted_batch_never_happened(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)
    store = EmbeddingStore(spark, str(tmp_path / "s"))
    with pytest.raises(Exception, match="no vectors today"):
        store.add(docs(spark, range(10)), Counting(counter, fail=True))
    spark.createDataFrame([("x", [1.0, 1.0])], "digest string, vector array<double>").write.parquet(str(tmp_path / "s" / "batches" / ("batch-" + "0" * 32)))
    assert store.vectors().count() == 0
    assert store.add(docs(spark, range(10)), Counting(counter)) == 10 and store.vectors().count() == 10
    assert store.add(docs(spark, []), Counting(counter)) == 0 and store.commits().count() == 1
