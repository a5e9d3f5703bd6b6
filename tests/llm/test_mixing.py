"""Mixing: equality with its SQL on odd rows, exact totals, caps, permutations and reruns."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import differences
from textguard.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, block string"
ROWS = [
    (1, "a b c", "s1"), (2, None, "s1"), (3, "", "s2"), (4, " \t\n ", None), (None, "x " * 700, None), (5, "é b c", "émile"),
    (6, "w " * 5000, "big"), (7, "one", "z"), (7, "one", "z"), (7, "one", "z"), (8, "two words", ""), (9, None, "empty"),
] + [(20, "same text here " * 5, "hot")] * 40


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, -1, 7, "x") for i, t, s in rows], SCHEMA)


def oracle(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, 0)", [list(r) for r in rows])
    return con


@pytest.mark.parametrize("rows", [ROWS, [], [(1, None, None)], [(1, "", "a"), (2, "word", "a")]])
def test_mix_equals_sql(spark, rows):
    _, _, problems = differences(mixing.query(frame(spark, rows)), oracle(rows), mixing.SQL)
    assert not problems


def test_totals_caps_and_reruns(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randrange(0, 400), "hot" if k % 3 else f"s{k % 17}") for k in range(900)]
    out = mixing.query(frame(spark, rows)).collect()
    by_source = collections.defaultdict(lambda: [0, 0.0])
    for r, (_, _, s) in zip(sorted(out, key=lambda r: r.doc_id), rows):
        assert r.taken <= 2 * r.size
        by_source[s][0] += r.taken
        by_source[s][1] = r.target
    assert all(abs(taken - target) <= 2 * mixing.BLOCK_WORDS for taken, target in by_source.values())
    assert abs(sum(t for _, t in by_source.values()) - 1.5 * sum(r.size for r in out)) < 1e-6 * len(out)
    again = mixing.query(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_pieces_fill_the_blocks(spark):
    rows = [(k, "w " * (k * 13 % 90), "a" if k % 2 else "b") for k in range(60)]
    plan = mixing.mix(frame(spark, rows), block_words=16, shard_blocks=10)
    got = mixing.pieces(plan).groupBy("shard", "source_no", "use", "block").agg(F.sum("n_words").alias("n")).collect()
    assert len(got) == plan.slots.count() and all(0 < r.n <= 16 for r in got)
    last = {r.source_no: r.blocks - 1 for r in plan.sources.collect()}
    assert all(r.n == 16 for r in got if r.block != last[r.source_no])
    sizes = collections.Counter(r["shard"] for r in plan.slots.collect())
    assert set(sizes.values()) <= {10, sum(sizes.values()) % 10}
    assert len({r.source_no for r in plan.slots.where("shard = 0").collect()}) == 2


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_one(spark, n):
    rows = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("long").alias("blocks"), F.lit(12345).cast("long").alias("seed"))
    got = mixing.with_permuted(rows, "block").orderBy("x").collect()
    assert sorted(r.block for r in got) == list(range(n))
    if n >= 64:
        assert sum(r.block == r.x for r in got) < n / 8
        assert sum(abs(a.block - b.block) <= 2 for a, b in zip(got, got[1:])) < n / 8


def test_draws_are_even(spark):
    counts = collections.Counter(r.draw % 50 for r in mixing.with_draws(spark.range(50_000), "draw", 50).collect())
    assert len(counts) == 50 and sum((c - 1000) ** 2 / 1000 for c in counts.values()) < 95
