"""Per-dimension aggregation of vectors: mean, sum, max, min, median, mean_top_3.

``aggregate_by`` groups rows that already hold vectors (any group size); ``document_vectors``
averages the word vectors of each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from textguard.errors import UnknownMethodError
from textguard.functions.text import split_words
from textguard.session import write_through

METHODS = ("mean", "sum", "max", "min", "median", "mean_top_3")
BROADCAST_BYTES = 256 * 1024 * 1024
LOOKUP_BYTES = 16 * 1024 * 1024
SHIPPED_BYTES = 32 * 1024 * 1024  # of vectors that pass through the driver, which holds them several times
HOME_CHARS = 10_000_000  # length of the texts that one task looks up together


def exact_median(df: DataFrame, keys: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median per group without holding a group in memory.

    A quantile sketch (rank error below rows / accuracy) brackets the median; rows under the
    bracket are only counted, and the few inside are counted per value and ranked.
    """
    slack = 2.0 / accuracy
    marks = df.groupBy(*keys).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(value, [0.5 - slack, 0.5 + slack], accuracy).alias("_q"),
    )
    joined = df.join(marks, keys).select(*keys, value, "_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    # one row per value inside the bracket; everything below shares one row (null value)
    parts = (
        joined.where(F.col(value) <= F.col("_hi"))
        .select(*keys, "_n", F.when(F.col(value) >= F.col("_lo"), F.col(value)).alias("_v"))
        .groupBy(*keys, "_n", "_v")
        .agg(F.count("*").alias("_c"))
    )
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
    ranked = parts.withColumn("_upto", upto)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return ranked.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_upto") >= low, F.col("_v")))
                + F.min(F.when(F.col("_upto") >= high, F.col("_v")))
            )
            / 2
        ).alias("value")
    )


def aggregate_by(df: DataFrame, keys: list[str], vector: str, method: str = "mean") -> DataFrame:
    """(keys, dim, value): one row per group and dimension. Hot groups combine on the map side."""
    if method not in METHODS:
        raise UnknownMethodError(f"unknown aggregation {method}")
    if method in ("mean", "sum", "max", "min"):
        summary = df.select(*keys, array_to_vector(F.col(vector)).alias("_v")).groupBy(*keys).agg(
            Summarizer.metrics(method).summary(F.col("_v")).alias("_s")
        )
        return summary.select(*keys, F.posexplode(vector_to_array(f"_s.{method}")).alias("dim", "value"))
    long = df.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    if method == "median":
        return exact_median(long, [*keys, "dim"], "value")
    # ranks are limited before the shuffle, so each task sends three values per group and dimension
    top = W.partitionBy(*keys, "dim").orderBy(F.desc("value"))
    return long.withColumn("_r", F.row_number().over(top)).where("_r <= 3").groupBy(*keys, "dim").agg(F.avg("value").alias("value"))


def _reduce(vectors: np.ndarray, method: str, size: int) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros(size)
    if method == "mean_top_3":
        return np.sort(vectors, axis=0)[-min(3, len(vectors)) :].mean(axis=0)
    return getattr(np, method)(vectors, axis=0)


def document_vectors(
    df: DataFrame,
    word_vectors: DataFrame,
    method: str = "mean",
    text_col: str = "text",
    id_col: str = "doc_id",
    output: str = "vector",
    broadcast_bytes: int = SHIPPED_BYTES,
) -> DataFrame:
    """Add ``output``: the aggregate of the vectors of a text's known words; zeros if none is known.

    Words are looked up lower-cased; unknown words are skipped, null texts give zeros. Of a large vector
    table only the words of the texts are kept; a table below ``broadcast_bytes`` is shipped to the tasks; a larger one is joined to the words.
    """
    if method not in METHODS:
        raise UnknownMethodError(f"unknown aggregation {method}")
    # a word listed more than once counts with its smallest vector
    word_vectors = word_vectors.groupBy("word").agg(F.min("vector").alias("vector"))
    shape = word_vectors.agg(F.count("*").alias("n"), F.first(F.size("vector")).alias("size")).first()
    size = int(shape["size"] or 0)
    schema = StructType([*df.schema.fields, StructField(output, ArrayType(DoubleType()))])
    if shape["n"] * (8 * size + 64) > LOOKUP_BYTES:
        # every Python worker holds the table it looks words up in, so only words that occur are shipped
        wanted = df.select(F.explode(F.array_distinct(split_words(text_col, lowercase=True))).alias("word")).distinct()
        word_vectors = write_through(word_vectors.join(wanted, "word", "left_semi"))
        shape = word_vectors.agg(F.count("*").alias("n")).first()
    if shape["n"] * (8 * size + 64) <= broadcast_bytes:
        return _by_lookup(df, word_vectors, method, text_col, schema, size)
    return _by_join(df, word_vectors, method, text_col, id_col, output, size)


def _by_lookup(df, word_vectors, method, text_col, schema, size):
    rows = word_vectors.toPandas()
    matrix = np.stack(rows["vector"].map(np.asarray)).astype("float64") if len(rows) else np.zeros((0, size))
    table = df.sparkSession.sparkContext.broadcast((dict(zip(rows["word"], range(len(rows)))), matrix))
    output = schema.fields[-1].name

    def run(batches):
        places, values = table.value
        for batch in batches:
            vectors = []
            for text in batch[text_col]:
                words = text.lower().split() if isinstance(text, str) else ()
                hits = [places[w] for w in words if w in places]
                vectors.append(_reduce(values[hits], method, size))
            batch[output] = vectors
            yield batch

    return df.mapInPandas(run, schema)


def _by_join(df, word_vectors, method, text_col, id_col, output, size):
    # rows are told apart by their text too; rows of equal id and text share their vector
    own = id_col in df.columns
    df = df if own else df.withColumn(id_col, F.lit(0))
    df = df.withColumn("_text", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    texts = df.dropDuplicates([id_col, "_text"])
    # texts are dealt to homes of bounded length, and a vector is sent once to each home that needs it
    homes = -(-(texts.agg(F.sum(F.length(text_col))).first()[0] or 1) // HOME_CHARS)
    home = F.pmod(F.xxhash64(id_col, "_text"), F.lit(homes)).alias("home")
    dealt = texts.select(home, F.col(id_col).alias("_id"), F.col("_text").alias("_key"), split_words(text_col, lowercase=True).alias("words"))
    dealt = dealt.where(F.size("words") > 0)
    wanted = dealt.select("home", F.explode(F.array_distinct("words")).alias("word")).distinct()
    fetched = wanted.join(word_vectors, "word").select(F.col("home").alias("to"), "word", "vector")
    id_type = df.schema[id_col].dataType.simpleString()

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        values = known["vector"].combine_chunks().flatten().to_numpy().reshape(known.num_rows, -1)
        lists = rows["words"].combine_chunks()
        place = pc.fill_null(pc.index_in(lists.flatten(), known["word"].combine_chunks()), -1).to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy())[:-1]
        hits = [x[x >= 0] for x in np.split(place, ends)] if rows.num_rows else []
        some = [k for k, x in enumerate(hits) if len(x)]
        out = rows.select(["_id", "_key"]).take(pa.array(some, pa.int64()))
        return out.append_column("_out", pa.array([_reduce(values[hits[k]].astype("float64"), method, size) for k in some], pa.list_(pa.float64())))

    found = dealt.groupBy("home").cogroup(fetched.groupBy("to")).applyInArrow(run, f"_id {id_type}, _key string, _out array<double>")
    zeros = F.array_repeat(F.lit(0.0), size)
    same = df[id_col].eqNullSafe(found["_id"]) & (df["_text"] == found["_key"])
    return df.join(found, same, "left").withColumn(output, F.coalesce("_out", zeros)).drop("_out", "_id", "_key", "_text", *([] if own else [id_col]))
