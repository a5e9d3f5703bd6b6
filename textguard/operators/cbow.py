"""Continuous-bag-of-words vectors with parameter tables sharded by word.

The corpus is cut into blocks of about ``block_words`` words, a few of which share a home. In every epoch each
home fetches the two vectors of its own words and of its share of noise words from the parameter table by a join,
runs minibatch descent with negative sampling over the sentences of each block, and returns what changed. Changes are
averaged by word and added to the table, which is written to shared storage; the table before it is removed. Neither the vocabulary nor the vectors
ever meet on the driver or in one task: memory follows the home, parallelism the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from textguard.functions.text import split_words
from textguard.session import drop_table, write_through

SENTENCE_WORDS = 1000
BATCH = 64
START_RATE, END_RATE = 0.025, 0.0001
NOISE_POWER = 0.75
HOME_BLOCKS = 8
SHARD_ROWS = 40_000  # changes added up by one task
CHANGE = "code long, d_in array<float>, d_out array<float>, t_in int, t_out int"
EMPTY = pa.schema([("code", pa.int64()), ("d_in", pa.list_(pa.float32())), ("d_out", pa.list_(pa.float32())), ("t_in", pa.int32()), ("t_out", pa.int32())])


def word_counts(df: DataFrame, text_col: str = "text", min_count: int = 2) -> DataFrame:
    """(word, n) of the white-space pieces that occur at least ``min_count`` times."""
    pieces = df.where(F.col(text_col).isNotNull()).select(F.explode(split_words(text_col)).alias("word"))
    return pieces.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def start_vectors(words: DataFrame, size: int, seed: int, sample: float) -> DataFrame:
    """One row per word: code, start vectors, noise weight and the share of its occurrences that training keeps."""
    total = words.agg(F.sum("n")).scalar()
    unit = lambda i: (F.pmod(F.xxhash64("word", i, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24) - 0.5) / size
    share = F.col("n") / total
    keep = F.least(F.lit(1.0), (F.sqrt(share / sample) + 1) * sample / share) if sample else F.lit(1.0)
    return words.select(
        "word", "n", F.xxhash64("word").alias("code"), F.pow("n", F.lit(NOISE_POWER)).alias("noise"), keep.alias("keep"),
        F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: unit(i).cast("float")).alias("vec_in"),
        F.array_repeat(F.lit(0.0).cast("float"), size).alias("vec_out"),
    )


def sentences(df: DataFrame, text_col: str, block_words: int) -> tuple[DataFrame, int]:
    """(block, codes) rows of at most ``SENTENCE_WORDS`` words, and the number of blocks."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.transform(split_words(text_col), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
    last = F.expr(f"(size(w) - 1) div {SENTENCE_WORDS}")
    parts = rows.select("w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    parts = parts.select(F.slice("w", (F.col("k") * SENTENCE_WORDS + 1).cast("int"), F.lit(SENTENCE_WORDS)).alias("codes"))
    parts = write_through(parts.withColumn("row", F.monotonically_increasing_id()))
    total = parts.agg(F.sum(F.size("codes"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    return parts.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "codes"), blocks


def descend(
    texts: list[np.ndarray], vec_in: np.ndarray, vec_out: np.ndarray, keep: np.ndarray, noise: np.ndarray, window: int, negative: int,
    rate: float, rng: np.random.Generator,
) -> None:
    """One pass over texts of word places, in place: the mean of the context predicts the word in the middle.

    ``noise`` lists the places from which wrong words are drawn. Every word has a window of its own, up to ``window``.
    """
    texts = [t[rng.random(len(t)) < keep[t]] for t in texts]
    words = np.concatenate([np.zeros(0, np.int64), *texts])
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    steps = np.array([s for s in range(-window, window + 1) if s])
    # Changes of a batch add up, so a small vocabulary, whose words recur in every batch, takes smaller ones.
    batch = min(BATCH, max(2, len(vec_in) // 10))
    for at in np.array_split(np.arange(len(words)), max(1, len(words) // batch)):
        near = at[:, None] + steps
        inside = np.clip(near, 0, max(0, len(words) - 1))
        reach = rng.integers(1, window + 1, len(at))[:, None]
        seen = (near == inside) & (text[inside] == text[at][:, None]) & (np.abs(steps) <= reach)
        at, inside, seen = (x[seen.any(1)] for x in (at, inside, seen))
        if not len(at):
            continue
        context = np.where(seen, words[inside], 0)
        share = (seen / seen.sum(1, keepdims=True)).astype(vec_in.dtype)
        mean = (share[:, None, :] @ vec_in[context])[:, 0]
        drawn = noise[rng.integers(0, len(noise), (len(at), negative))]
        target = np.concatenate([words[at][:, None], drawn], 1)
        wanted = np.zeros(target.shape, vec_in.dtype)
        wanted[:, 0] = 1
        against = vec_out[target]
        score = 1 / (1 + np.exp(-np.clip((against @ mean[:, :, None])[:, :, 0], -30, 30)))
        pull = vec_in.dtype.type(rate) * (wanted - score)
        pull[:, 1:][drawn == words[at][:, None]] = 0
        change = (pull[:, None, :] @ against)[:, 0]
        row, _ = np.nonzero(seen)
        _add_rows(vec_out, target.ravel(), np.repeat(np.arange(len(at)), target.shape[1]), pull.ravel(), mean)
        _add_rows(vec_in, context[seen], row, None, change)


def _add_rows(table: np.ndarray, place: np.ndarray, row: np.ndarray, weight: np.ndarray | None, rows: np.ndarray) -> None:
    """``table[place] += weight * rows[row]`` with repeated places, as one small product."""
    places, at = np.unique(place, return_inverse=True)
    share = np.bincount(at * len(rows) + row, weight, len(places) * len(rows)).reshape(len(places), len(rows))
    table[places] += share.astype(table.dtype) @ rows


def _rows(table: pa.Table, column: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    values = table[column].combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(matrix) + 1, dtype="int32") * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.astype("float32").ravel()))


def _home(window: int, negative: int, rate: float, seed: int):
    """The blocks of a home, each from the same vectors; their changes are added up before they leave the task."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows or not known.num_rows:
            return EMPTY.empty_table()
        order = np.argsort(known["code"].to_numpy())
        codes, keep = (known[c].to_numpy()[order] for c in ("code", "keep"))
        start_in, start_out = (_rows(known, c)[order] for c in ("vec_in", "vec_out"))
        noise = known["noise"].combine_chunks()
        some = np.flatnonzero(noise.value_lengths().to_numpy()[order])
        drawn = [(x["block"], i, x["times"]) for i in some for x in noise[int(order[i])].as_py()]
        noise_block, noise_word, noise_times = np.array(drawn or np.zeros((0, 3)), "int64").T
        d_in, d_out = np.zeros_like(start_in), np.zeros_like(start_out)
        t_in, t_out = np.zeros(len(codes), "int32"), np.zeros(len(codes), "int32")
        block, lists = texts["block"].to_numpy(), texts["codes"].combine_chunks()
        for b in np.unique(block):
            lines = []
            for row in sorted((lists[int(k)].values.to_numpy() for k in np.flatnonzero(block == b)), key=lambda r: r.tobytes()):
                at = np.minimum(np.searchsorted(codes, row), len(codes) - 1)
                lines.append(at[codes[at] == row])  # words below the minimal count have no row
            own = noise_block == b
            words = np.unique(np.concatenate([*lines, noise_word[own]]))
            if not len(words):
                continue
            lines = [np.searchsorted(words, x) for x in lines]
            noise = np.repeat(np.searchsorted(words, noise_word[own]), noise_times[own])
            vec_in, vec_out = start_in[words], start_out[words]
            rng = np.random.default_rng([seed, int(b)])
            descend(lines, vec_in, vec_out, keep[words], noise if len(noise) else np.arange(len(words)), window, negative, rate, rng)
            vec_in -= start_in[words]
            vec_out -= start_out[words]
            d_in[words] += vec_in
            d_out[words] += vec_out
            t_in[words] += vec_in.any(1)
            t_out[words] += vec_out.any(1)
        moved = np.flatnonzero(t_in | t_out)
        return pa.table([codes[moved], _lists(d_in[moved]), _lists(d_out[moved]), t_in[moved], t_out[moved]], EMPTY)

    return run


def _moved(schema: pa.Schema):
    """Each vector of a shard plus the mean of its changes over the blocks that changed it."""

    def run(words: pa.Table, changes: pa.Table) -> pa.Table:
        if not words.num_rows or not changes.num_rows:
            return words.select(schema.names).cast(schema)
        codes = words["code"].to_numpy()
        order = np.argsort(codes)
        changed, at = np.unique(changes["code"].to_numpy(), return_inverse=True)
        sequence = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[sequence], prepend=-1))
        place = order[np.searchsorted(codes, changed, sorter=order)]
        for vector, delta, times in (("vec_in", "d_in", "t_in"), ("vec_out", "d_out", "t_out")):
            total = np.add.reduceat(_rows(changes, delta)[sequence], starts, axis=0)
            n = np.add.reduceat(changes[times].to_numpy()[sequence], starts)
            now = _rows(words, vector).copy()
            now[place] += total / np.maximum(n, 1)[:, None]
            words = words.set_column(words.schema.get_field_index(vector), vector, _lists(now))
        return words.select(schema.names).cast(schema)

    return run


def train_cbow(
    df: DataFrame, text_col: str = "text", vector_size: int = 100, window: int = 5, min_count: int = 2, epochs: int = 10, negative: int = 5,
    sample: float = 1e-3, rate: float = START_RATE, seed: int = 42, block_words: int = 50_000, noise_words: int = 1000,
) -> DataFrame:
    """(word, vector) of the words that occur ``min_count`` times, trained on white-space pieces in their original case.

    Null and blank texts are skipped; without any frequent word the table is empty. Words are told apart
    by 64-bit codes. Each block receives about ``noise_words`` noise words an epoch, drawn in proportion to
    ``n ** 0.75`` where the words are stored.
    """
    words = write_through(start_vectors(word_counts(df, text_col, min_count), vector_size, seed, sample))
    texts, blocks = sentences(df, text_col, block_words)
    texts = write_through(texts)
    noise_sum = words.agg(F.sum("noise")).first()[0]
    if noise_sum is None:
        return words.select("word", F.col("vec_in").alias("vector"))
    # Words that blocks of a home share are fetched once, and their changes are sent once.
    slots = df.sparkSession.sparkContext.defaultParallelism
    size = min(HOME_BLOCKS, max(1, blocks // (2 * slots)))
    homes = math.ceil(blocks / size)
    home = F.expr(f"block div {size}").alias("home")
    texts = texts.select(home, "block", "codes")
    used = texts.select("home", F.explode(F.array_distinct("codes")).alias("code")).distinct()
    used = write_through(used.join(words.select("code"), "code", "left_semi"))
    shards = math.ceil((used.count() + homes * size * noise_words) / SHARD_ROWS)
    schema = to_arrow_schema(words.schema)
    # A home is much work on few bytes, so homes keep tasks of their own; with many more tasks few homes meet in one.
    tasks = 4 * homes
    texts = texts.repartition(tasks, "home")
    for epoch in range(epochs):
        now = rate + (END_RATE - rate) * epoch / max(1, epochs)
        mean = F.col("noise") * (blocks * noise_words / noise_sum)
        luck = F.pmod(F.xxhash64("code", F.lit(seed), F.lit(epoch)), F.lit(1 << 24)) / float(1 << 24)
        copies = F.floor(mean) + (luck < mean - F.floor(mean)).cast("long")
        noise = words.select("code", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("k"), copies.alias("c")).where("c > 0")
        noise = noise.select(F.pmod(F.xxhash64("code", "k", F.lit(epoch)), F.lit(blocks)).alias("block"), "code")
        noise = noise.groupBy("block", "code").agg(F.count("*").cast("int").alias("times")).select(home, "code", F.struct("block", "times").alias("noise"))
        wanted = used.withColumn("noise", F.lit(None).cast(noise.schema["noise"].dataType)).unionByName(noise)
        wanted = wanted.groupBy("home", "code").agg(F.collect_list("noise").alias("noise"))
        fetched = wanted.join(words.select("code", "keep", "vec_in", "vec_out"), "code")
        changes = texts.groupBy("home").cogroup(fetched.repartition(tasks, "home").groupBy("home")).applyInArrow(_home(window, negative, now, seed + epoch), CHANGE)
        shard = F.pmod(F.col("code"), F.lit(shards)).alias("shard")
        before = words
        words = write_through(
            words.select("*", shard).groupBy("shard").cogroup(changes.select("*", shard).groupBy("shard")).applyInArrow(_moved(schema), words.schema)
        )
        drop_table(before)
    return words.select("word", F.col("vec_in").alias("vector"))
