"""N-gram Jaccard join by parity sketches: XOR sketches per size band, pigeonhole join, exact check.

The tokens of a set fall into ``P`` cells and every cell keeps the XOR of its tokens' hashes. Each token in
which two sets differ changes one cell, so the number of differing cells, like the Hamming distance of a
one-bit-per-token sketch, never exceeds the symmetric difference. Sets of Jaccard similarity ``t`` differ
in at most ``d = (1 - t) / (1 + t) * (|A| + |B|)`` tokens; with ``P = d + 1 + slack`` cells at least
``1 + slack`` are equal, and an equality join on single cells finds the pair. ``d`` follows a band of sizes:
the smaller set of a pair lies in the band, and the larger one there or a little above. So a set takes part in
the join of its own band, and in that of the band below if a set of that band can be similar to it.

Pairs are not made within a cell. In rounds every set is compared with a few leaders, one for each seed, out of
all its cells; what they link is one component, and only cells that still hold several components go on.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import ascii_lower, components, list_parts, materialise, mix, shingles, word_hashes

WORDS = 4
PERCENT = 85
BITS = 2048
LEADERS = (16.0, 4.0, 1.0, 0.0)  # leaders of a cell, and of a set in a round: how much those in large cells are preferred
ROUNDS = 2
SMALL = 16  # cells of more sets are compared tile by tile
BLOCK = 1024  # sets on a side of a tile
U64 = np.uint64


def band_bounds(largest: int, percent: int) -> list[int]:
    """Upper bounds of the size bands up to ``largest``; similar sets lie in one band or in adjacent ones."""
    bounds = [1]
    while bounds[-1] < largest:
        bounds.append(max((bounds[-1] + 1) * 100 // percent, bounds[-1] * 27 // 20))
    return bounds


def cells(tokens: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the cells that have tokens, XOR of each)."""
    cell = ((tokens >> U64(32)) % U64(count)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    number, start = np.unique(cell[order], return_index=True)
    return number, np.bitwise_xor.reduceat(tokens[order], start)


def join_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: two sets of the wanted similarity share at least one.

    Equal empty cells are no evidence and give no key. If a set has more than ``slack`` of them, equal
    cells could all be empty; such sets, and both sides of the pair are such, also meet on the tokens that
    a set of that similarity must share: the first ``n - ceil(t n) + 1`` by hash.
    """
    n = len(tokens)
    bounds = band_bounds(n, percent)
    band = bisect.bisect_left(bounds, n)
    out = []
    for join in (band, band - 1):
        if join < 0 or (n * percent + 99) // 100 > bounds[max(join, 0)]:
            continue  # no set of the band below is large enough
        d = bounds[join] * (100 - percent) // percent
        least = bounds[join - 1] + 1 if join else 1
        slack = 2 + int(1.5 * d * math.exp(-least / (d + 1))) if d else 0  # more than are empty in most sets
        number, xor = cells(tokens, d + 1 + slack)
        out.append(mix(xor + mix(number.astype(U64) + U64(join + 1) * U64(1 << 32))))
        if d + 1 + slack - len(number) > slack:
            prefix = np.sort(tokens)[: n - (n * percent + 99) // 100 + 1]
            out.append(mix(prefix ^ mix(np.full(1, join + 1, U64) * U64(0xD6E8FEB86659FD93))))
    return np.unique(np.concatenate(out))


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each of ``BITS`` bits."""
    return np.packbits(np.bincount((mix(tokens) % U64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _sets(batch: pa.RecordBatch, at: int, words: int) -> Iterator[tuple[int, np.ndarray]]:
    values, offsets = list_parts(batch.column(at))
    values = values.astype(np.int64)
    for i in range(batch.num_rows):
        yield i, np.unique(shingles(values[offsets[i] : offsets[i + 1]], words))


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), set_id(s) if len(s) else None) for _, s in _sets(batch, batch.num_columns - 1, words)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                names=[*batch.schema.names[:-1], "n_shingles", "sid"],
            )

    return run


def _emit_keys(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # spares a task the repeated keys of copies; emptied when large
        for batch in batches:
            keys, sids, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for _, s in _sets(batch, 0, words):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sid)
                keys.append(join_keys(s, percent).view(np.int64))
                sids.append(np.full(len(keys[-1]), sid))
                size += len(keys[-1])
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, sids)], names=["key", "sid"])
                    keys, sids, size = keys[:1], sids[:1], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, sids)], names=["key", "sid"])

    return run


def _emit_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(set_id(s), len(s), sketch(s), s.tobytes()) for _, s in _sets(batch, 0, words) if len(s)]
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["sid", "n", "bits", "tokens"])

    return run


def near(na: int, nb: int, bits_a: bytes, bits_b: bytes, percent: int) -> bool:
    """Whether sizes and the Hamming distance of the bit sketches, a lower bound, leave the pair possible."""
    d = (na + nb) * (100 - percent) // (100 + percent)
    return abs(na - nb) <= d and int(np.bitwise_count(np.frombuffer(bits_a, U64) ^ np.frombuffer(bits_b, U64)).sum()) <= d


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """Exact test of two sets."""
    na, nb = len(a) // 8, len(b) // 8
    both = len(np.intersect1d(np.frombuffer(a, U64), np.frombuffer(b, U64), assume_unique=True))
    return 100 * both >= percent * (na + nb - both)


def _verify(test, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
            ok = pa.array([test(*values, percent) for values in zip(*columns)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

    return run


def _tested(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...], test, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that pass a test of these columns of both sets."""
    left, right = (sets.select(F.col("sid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))
    return both.mapInArrow(_verify(test, percent), "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The similar pairs. Sketches are compared first; the sets are fetched for what they leave."""
    close = materialise(_tested(pairs, sets, ("n", "bits"), near, percent), "close")
    return materialise(_tested(close, sets, ("tokens",), similar, percent), "links")


def _open(held: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows ``(key, sid, c)`` of the cells that hold more than one component ``c``."""
    if found is None:
        return held.withColumn("c", F.col("sid"))
    placed = held.join(found.withColumnRenamed("id", "sid"), "sid", "left").select("key", "sid", F.coalesce("component_id", "sid").alias("c"))
    several = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return placed.join(several.select("key"), "key", "left_semi")


def _stars(held: DataFrame, turn: int) -> DataFrame:
    """At most ``len(LEADERS)`` pairs ``(a, b)`` of a set with leaders of its cells in other components: those it
    meets in most cells. Leaders are drawn by the number of other sets in all their cells, as the middle of a
    group of near copies shares more cells than its edge."""
    size = held.groupBy("key").agg((F.count("*") - 1).alias("others"))
    weight = held.join(size, "key").groupBy("sid").agg(F.sum("others").cast("double").alias("weight"))
    chance = [(F.xxhash64(F.lit(turn * len(LEADERS) + k), "sid").cast("double") / 2.0**64 + 0.5000001) for k in range(len(LEADERS))]
    order = [F.struct((F.log(-F.log(u / 1.000001)) - p * F.log("weight")).alias("h"), F.col("sid").alias("a"), F.col("c").alias("ca")) for u, p in zip(chance, LEADERS)]
    leaders = held.join(weight, "sid").groupBy("key").agg(*(F.min(o).alias(f"l{k}") for k, o in enumerate(order)))
    met = held.join(leaders, "key").select("sid", "c", F.explode(F.array_distinct(F.array(*(f"l{k}" for k in range(len(order)))))).alias("l"))
    met = met.where("l.ca <> c").groupBy(F.col("sid"), F.col("l.a").alias("lead")).agg(F.count("*").alias("cells"))
    best = Window.partitionBy("sid").orderBy(F.desc("cells"), F.xxhash64(F.lit(turn), "lead"))
    met = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= len(LEADERS))
    return met.select(F.least("sid", "lead").alias("a"), F.greatest("sid", "lead").alias("b")).distinct()


def _tile(percent: int):
    """The pairs of different components between the two blocks of a tile that sketches leave."""

    def run(tile: pa.Table) -> pa.Table:
        sid, c, n, block = (tile.column(x).to_numpy() for x in ("sid", "c", "n", "block"))
        bits = np.frombuffer(b"".join(tile.column("bits").to_pylist()), U64).reshape(len(sid), -1)
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        right, found = np.flatnonzero(block == j), []
        for x in np.flatnonzero(block == i):
            y = right[right > x] if i == j else right
            d = (n[y] + n[x]) * (100 - percent) // (100 + percent)
            fits = (c[y] != c[x]) & (np.abs(n[y] - n[x]) <= d)
            y, d = y[fits], d[fits]
            y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64) <= d]
            found.append(np.stack([np.full(len(y), sid[x]), sid[y]]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _rest(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of one cell in different components that sketches leave. Small cells are joined; the sets of a
    large one fall into blocks, and every two blocks are a tile of bounded size, so that no row is made for a pair
    that sketches refuse."""
    size = held.groupBy("key").agg(F.count("*").alias("m"))
    held = held.join(size, "key")
    few = held.where(F.col("m") <= SMALL)
    other = few.select("key", F.col("sid").alias("b"), F.col("c").alias("cb"))
    pairs = few.join(other, "key").where("sid < b AND c <> cb").select(F.col("sid").alias("a"), "b").distinct()
    pairs = _tested(materialise(pairs, "rest"), sets, ("n", "bits"), near, percent)
    blocks = F.ceil(F.col("m") / BLOCK)
    many = held.where(F.col("m") > SMALL).withColumn("block", F.pmod(F.xxhash64("key", "sid"), blocks))
    many = many.select("key", "sid", "c", "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("with"))
    many = many.join(sets.select("sid", "n", "bits"), "sid").select(
        "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "sid", "c", "n", "bits"
    )
    return pairs.union(many.groupBy("key", "i", "j").applyInArrow(_tile(percent), "a long, b long")).distinct()


def _linked(cells_of: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join all sets of a component: leaders in rounds, then every pair of sets of one cell that are
    still in different components."""
    links, found, held = None, None, cells_of
    for k in range(ROUNDS):
        held = materialise(_open(held.select("key", "sid"), found), "open")
        stars = materialise(_stars(held, k), "stars")
        new = _links(stars, sets, percent)
        links = new if links is None else links.union(new)
        found = components(cells_of.sparkSession, links)
    held = materialise(_open(held.select("key", "sid"), found), "open")
    close = materialise(_rest(held, sets, percent), "close")
    return links.union(materialise(_tested(close, sets, ("tokens",), similar, percent), "links"))


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``.

    Equal sets are one set from the start, and cells that hold the same sets are one cell. In rounds the sets are
    compared with leaders out of their cells, which settles groups of near copies without their pairs; only sets of
    a cell that are still in different components are then compared with each other, so no link between components
    is lost. Cell keys are hashes of about five shingles each and every set has many, so a common text
    spreads over many keys. Null and wordless texts have no shingle and are linked with nothing; a null
    id never names a component that has another id; repeated rows share their set; an empty table stays empty.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    split = word_hashes(ascii_lower(F.col("text"))).alias("w")
    kind = base.schema["doc_id"].dataType.simpleString()
    described = materialise(base.select("doc_id", "th", split).mapInArrow(_describe(words), f"doc_id {kind}, th long, n_shingles long, sid long"), "sets")
    cell = Window.partitionBy("key")
    raw = base.select(split).mapInArrow(_emit_keys(words, percent), "key long, sid long")
    shared = raw.withColumn("low", F.min("sid").over(cell)).withColumn("high", F.max("sid").over(cell)).where("low <> high")
    shared = shared.select("key", "sid").distinct().withColumn("same", F.bit_xor(F.xxhash64("sid")).over(cell))
    shared = materialise(shared.select(F.col("same").alias("key"), "sid").distinct(), "cells")
    sources = described.join(shared.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("th").alias("th"))
    texts = base.select("th", "text").join(sources.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"])
    sets = texts.select(split).mapInArrow(_emit_sets(words), "sid long, n long, bits binary, tokens binary").dropDuplicates(["sid"])
    links = _linked(shared, materialise(sets, "tokens"), percent)
    roots = components(spark, links).select(F.col("id").alias("sid"), F.col("component_id").alias("root"))
    per_set = described.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("first")).join(roots, "sid", "left")
    per_set = per_set.withColumn("root", F.coalesce("root", "sid"))
    named = per_set.join(per_set.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("sid", "component_id")
    return described.join(named, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    return groups(docs)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g FROM d
), t AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.r AS a, b.r AS b FROM t a JOIN t b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT r, r FROM s UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
), low AS (SELECT reach.a AS r, min(s.doc_id) AS c FROM reach JOIN s ON reach.b = s.r GROUP BY reach.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(low.c, s.doc_id) AS component_id FROM s JOIN low USING (r)
"""
