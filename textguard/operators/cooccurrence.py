"""Document co-occurrence counts and word vectors trained on them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import text as T
from textguard.functions.stopwords import resolve_stop_words
from textguard.operators.aggregate_vectors import BROADCAST_BYTES
from textguard.operators.vectorize import vocabulary
from textguard.session import cut_lineage

GROUP_CELLS = 3_000_000  # counts of a group of terms, of which a task holds two
BUFFER = 1_000_000  # products of rare terms that are sorted at a time
SLICE = 4096  # counts of a frequent term whose products are added up at a time


def _deal(groups: int):
    """Each text's counts by term, split by the group of the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes")
            row = np.repeat(np.arange(batch.num_rows), codes.value_lengths().to_numpy())
            if not len(row):
                continue
            found = codes.flatten().dictionary_encode()
            known, at = found.dictionary.to_numpy(), found.indices.to_numpy()
            key = np.sort((row * groups + (known % groups)[at]) * len(known) + at)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            counts = np.diff(np.append(first, len(key))).astype("int32")
            cell, at = np.divmod(key[first], len(known))
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            ends = pa.array(np.append(starts, len(cell)).astype("int32"))
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column("doc").take(pa.array(cell[starts] // groups)), "part": cell[starts] % groups,
                "codes": pa.ListArray.from_arrays(ends, known[at]), "counts": pa.ListArray.from_arrays(ends, counts),
            })

    return run


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _chunks(work: np.ndarray) -> list[np.ndarray]:
    """Consecutive places of about ``BUFFER`` products in all."""
    return [c for c in np.split(np.arange(len(work)), np.flatnonzero(np.diff(np.cumsum(work) // BUFFER)) + 1) if len(c)]


def _add_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their values."""
    bits = int(values.max()).bit_length()
    if int(keys.max()).bit_length() + bits < 63:  # sorting numbers is much faster than ordering their places
        packed = np.sort(keys << bits | values)
        keys, values = packed >> bits, packed & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(values, starts)


def _block(left: pa.RecordBatch, right: pa.RecordBatch, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, x) of the block of X'X of two groups of terms, or the upper triangle of a group's own block."""
    docs, right_docs = (t.column("doc").to_numpy() for t in (left, right))
    sizes, right_sizes = (t.column("ids").value_lengths().to_numpy().astype("int64") for t in (left, right))
    ids, right_ids = (t.column("ids").flatten().to_numpy() for t in (left, right))
    counts, right_counts = (t.column("counts").flatten().to_numpy() for t in (left, right))
    order = np.argsort(right_docs)
    place = order[np.minimum(np.searchsorted(right_docs, docs, sorter=order), len(order) - 1)]
    there = right_docs[place] == docs
    names, codes = np.unique(right_ids, return_inverse=True)
    # the counts of a term one after the other, each with its document's span on the right
    begin = np.repeat((np.cumsum(right_sizes) - right_sizes)[place], sizes)
    length = np.repeat(np.where(there, right_sizes[place], 0), sizes)
    order = np.argsort(ids, kind="stable")
    ids, counts, begin, length = ids[order], counts[order], begin[order], length[order]
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    many = np.diff(np.append(first, len(ids)))
    work = np.add.reduceat(length, first)

    def products(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = _spans(begin[at], length[at])
        return codes[span], np.repeat(counts[at], length[at]) * right_counts[span]

    def named(i: np.ndarray, code: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        j = names[code]
        keep = i < j if same else np.full(len(i), True)
        return i[keep], j[keep], x[keep]

    dense = work * 4 >= len(names)
    for t in np.flatnonzero(dense):  # a frequent term has a row of sums
        at, x = first[t] + np.arange(many[t]), np.zeros(len(names), "int64")
        for start in range(0, len(at), SLICE):
            code, product = products(at[start : start + SLICE])
            x += np.bincount(code, product, len(names)).astype("int64")
        code = np.flatnonzero(x)
        yield named(np.full(len(code), ids[first[t]]), code, x[code])
    rare = np.flatnonzero(~dense & (work > 0))
    for chunk in _chunks(work[rare]):  # the products of many rare terms are sorted
        terms = rare[chunk]
        at = _spans(first[terms], many[terms])
        code, product = products(at)
        row = np.repeat(np.arange(len(terms)), work[terms])
        key, x = _add_up(row * len(names) + code, product)
        yield named(ids[first[terms[key // len(names)]]], key % len(names), x)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per group of terms, from rows that are sorted by group: its names, and its counts by document and place of the
    name. Codes without a name are left out; texts of one document are added up."""
    for group in _groups(batches):
        named = group.column("term").is_valid()
        words, rows = group.filter(named), group.filter(pc.invert(named))
        if not words.num_rows or not rows.num_rows:
            continue
        known = words.column("code").to_numpy()
        order = np.argsort(known)
        known = known[order]
        codes, counts = (rows.column(c).flatten().to_numpy() for c in ("codes", "counts"))
        docs, row = np.unique(rows.column("doc").to_numpy(), return_inverse=True)
        row = np.repeat(row, rows.column("codes").value_lengths().to_numpy())
        place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        there = known[place] == codes
        if not there.any():
            continue
        key, counts = _add_up(row[there] * len(known) + place[there], counts[there].astype("int64"))
        row, place = np.divmod(key, len(known))
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        ends = pa.array(np.append(starts, len(row)).astype("int32"))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype("int32"), counts)]
        names = pa.RecordBatch.from_pydict({"term": words.column("term").take(pa.array(order))})
        sums = pa.RecordBatch.from_pydict({"doc": docs[row[starts]], "ids": lists[0], "counts": lists[1]})
        yield pa.RecordBatch.from_pydict({"part": group.column("part")[:1], "names": pa.array([_pack(names)]), "rows": pa.array([_pack(sums)])})


def _products(mirror: bool):
    """Final sums of pairs of groups; one pair is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right, names, other_names = (_unpack(batch.column(c)[k]) for c in ("rows", "other_rows", "names", "other_names"))
                for i, j, x in _block(left, right, batch.column("part")[k] == batch.column("other")[k]):
                    w1, w2 = names.column("term").take(pa.array(i)), other_names.column("term").take(pa.array(j))
                    yield pa.RecordBatch.from_pydict({"w1": w1, "w2": w2, "x": x})
                    if mirror:
                        yield pa.RecordBatch.from_pydict({"w1": w2, "w2": w1, "x": x})

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a group as one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [*np.flatnonzero(np.diff(part, prepend=part[:1])), batch.num_rows]
        begin = 0
        for end in cuts:
            if held and end > begin and held[-1].column("part")[0] != batch.column("part")[begin]:
                yield pa.concat_batches(held)
                held = []
            if end > begin:
                held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield pa.concat_batches(held)


def _own_partitions(spark: SparkSession, groups: int) -> Column:
    """A key for every ``part``, such that hashing to ``groups`` partitions gives each part one of its own."""
    hashed = spark.range(64 * groups).groupBy(F.pmod(F.hash("id"), F.lit(groups)).alias("to")).agg(F.min("id").alias("id"))
    found = {r["to"]: r["id"] for r in hashed.collect()}
    return F.element_at(F.array(*[F.lit(found.get(part, part)).cast("long") for part in range(groups)]), (F.col("part") + 1).cast("int"))


def cooccurrence(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_df: int = 2,
    max_df: float = 0.95,
    stop_words: str | Sequence[str] | None = "english",
    mirror: bool = True,
) -> DataFrame:
    """(w1, w2, x): sum over documents of the product of the two words' counts, diagonal left out.

    The vocabulary is cut by ``min_df``/``max_df`` first; terms are told apart by 64-bit codes, and so are documents whose ids
    are no integers. Terms are dealt to groups, and one task has all counts of two groups and their words, so it makes final
    sums: counts are shuffled, products never. The number of groups follows the number of counts, which bounds a task's
    memory. A group is packed into one row of a checkpoint that the tasks read again, so that a count is shuffled and kept
    once, however many groups its own meets.
    """
    spark = df.sparkSession
    words = resolve_stop_words(stop_words)
    docs = df.select(id_col, F.coalesce(T.tokenize(text_col, stop_words=words, min_chars=1), F.array()).alias("tok"))
    vocab = cut_lineage(vocabulary(docs, "tok", min_df, max_df).select("term", F.xxhash64("term").alias("code"), "df"))
    cells = vocab.agg(F.sum("df")).first()[0] or 0
    groups = max(math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism)), math.ceil(cells / GROUP_CELLS))
    codes = docs.select(F.xxhash64(id_col).alias("doc"), F.transform("tok", lambda t: F.xxhash64(t)).alias("codes"))
    parts = codes.mapInArrow(_deal(groups), "doc long, part long, codes array<long>, counts array<int>")
    names = vocab.select(F.pmod("code", F.lit(groups)).alias("part"), "code", "term")
    parts = parts.unionByName(names, allowMissingColumns=True).repartition(groups, _own_partitions(spark, groups)).sortWithinPartitions("part")
    packed = cut_lineage(parts.mapInArrow(_packed, "part long, names binary, rows binary"))
    other = packed.select(F.col("part").alias("other"), F.col("names").alias("other_names"), F.col("rows").alias("other_rows"))
    both = packed.join(other.hint("shuffle_replicate_nl"), F.col("part") <= F.col("other"))
    pairs = both.mapInArrow(_products(mirror), "w1 string, w2 string, x long")
    if mirror:
        return pairs
    return pairs.select(F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2"), "x")


# --- vectors from co-occurrences -------------------------------------------------------------------

X_MAX, ALPHA = 100.0, 0.75  # weighting f(x) = min(1, (x / 100) ** 0.75)
GROUP_ROWS = 4096  # neighbours of a word solved together; words with more are split


def weight(x):
    return F.least(F.lit(1.0), F.pow(F.col(x) / X_MAX, F.lit(ALPHA)))


def _start_vectors(words: DataFrame, size: int, seed: int) -> DataFrame:
    """Small pseudo-random vectors and zero biases, a function of word and seed only."""
    parts = [
        ((F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("word")), F.lit(20001)) / 10000.0 - 1.0) * (0.5 / size)).cast("double")
        for i in range(size)
    ]
    return words.select("word", F.array(*parts).alias("vec"), F.lit(0.0).alias("bias"))


def _equations(size: int):
    """Partial normal equations of one slice of a word's neighbours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        other = np.column_stack([np.stack(pdf["vec"].map(np.asarray)), np.ones(len(pdf))])
        f = pdf["f"].to_numpy()
        target = pdf["logx"].to_numpy() - pdf["bias"].to_numpy()
        left = (other * f[:, None]).T @ other
        right = (other * (f * target)[:, None]).sum(axis=0)
        return pd.DataFrame({"word": [pdf["word"].iloc[0]], "a": [left.ravel()], "b": [right]})

    return run


def _solve(size: int, ridge: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = np.sum(np.stack(pdf["a"].map(np.asarray)), axis=0).reshape(size + 1, size + 1)
        right = np.sum(np.stack(pdf["b"].map(np.asarray)), axis=0)
        best = np.linalg.solve(left + ridge * np.eye(size + 1), right)
        return pd.DataFrame({"word": [pdf["word"].iloc[0]], "vec": [best[:-1]], "bias": [float(best[-1])]})

    return run


def _half_sweep(cells: DataFrame, fixed: DataFrame, size: int, ridge: float, broadcast: bool) -> DataFrame:
    """Best vectors of every word given the other side (``cells`` is symmetric: one layout serves both)."""
    side = fixed.withColumnRenamed("word", "other")
    joined = cells.join(F.broadcast(side) if broadcast else side, "other")
    partial = joined.groupBy("word", "part").applyInPandas(
        lambda pdf: _equations(size)(pdf), "word string, a array<double>, b array<double>"
    )
    return partial.groupBy("word").applyInPandas(_solve(size, ridge), "word string, vec array<double>, bias double")


def glove_loss(cells: DataFrame, main: DataFrame, context: DataFrame) -> float:
    """Weighted squared error of ``w.c + b + b'`` against ``log x``."""
    m = main.select(F.col("word"), F.col("vec").alias("v1"), F.col("bias").alias("b1"))
    c = context.select(F.col("word").alias("other"), F.col("vec").alias("v2"), F.col("bias").alias("b2"))
    dot = F.aggregate(F.zip_with("v1", "v2", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    err = dot + F.col("b1") + F.col("b2") - F.col("logx")
    return cells.join(m, "word").join(c, "other").agg(F.sum(F.col("f") * err * err).alias("loss")).first()["loss"]


def train_glove(
    cooc: DataFrame, size: int = 100, sweeps: int = 10, ridge: float = 0.05, seed: int = 42, with_loss: bool = False
):
    """(word, vector) minimising the weighted log-count loss by alternating least squares.

    Each half sweep solves one small system per word. A word's neighbours are split into slices of
    bounded size whose equations are added up; the fixed side is broadcast only if its size,
    known from the word count, is small. Sweeps are checkpointed.
    """
    cells = cooc.select(
        F.col("w1").alias("word"), F.col("w2").alias("other"), F.log("x").alias("logx"), weight("x").alias("f")
    )
    degree = cells.groupBy("word").agg(F.count("*").alias("_deg"))
    parts = F.ceil(F.col("_deg") / GROUP_ROWS)
    cells = cut_lineage(
        cells.join(degree, "word").withColumn("part", F.pmod(F.xxhash64("other"), parts)).drop("_deg")
    )
    words = cells.select("word").distinct()
    broadcast = words.count() * (8 * size + 64) <= BROADCAST_BYTES // 4
    context = cut_lineage(_start_vectors(words, size, seed))
    main, losses = context, []
    for _ in range(sweeps):
        main = cut_lineage(_half_sweep(cells, context, size, ridge, broadcast))
        context = cut_lineage(_half_sweep(cells, main, size, ridge, broadcast))
        if with_loss:
            losses.append(glove_loss(cells, main, context))
    both = main.alias("m").join(context.alias("c"), "word")
    vectors = both.select(
        "word", F.zip_with(F.col("m.vec"), F.col("c.vec"), lambda a, b: (a + b).cast("float")).alias("vector")
    )
    return (vectors, losses) if with_loss else vectors
