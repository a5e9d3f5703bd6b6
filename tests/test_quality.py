import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textguard.errors import DatasetColumnMismatchError
from textguard.operators import quality as Q
from textguard.operators import sampling as S
from textguard.operators.ordered import Running, by_ranges, running, scan
from textguard.operators.validate import apply_feature_engineering, validate_and_preprocess


def _key(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def binary(spark):
    return spark.createDataFrame([("foo bar", 0), ("baz qux", 1), ("normal text", 0), ("bad word", 1)], "text string, type int")


def test_merge(spark, binary):
    assert Q.merge_datasets([], spark).isEmpty()
    merged = Q.merge_datasets([binary, binary])
    assert merged.count() == 8 and merged.columns == binary.columns
    with pytest.raises(DatasetColumnMismatchError):
        Q.merge_datasets([binary, binary.select("type", "text")])


def test_validation_cases(spark):
    three = spark.createDataFrame([("Hello world", 0), ("Test 123", 1), ("Short", 0)], "text string, type int")
    assert validate_and_preprocess(three, {}).count() == 3
    same = spark.createDataFrame([("Same", 0), ("Same", 1), ("Other", 0)], "text string, type int").coalesce(1)
    kept = {r["text"]: r["type"] for r in validate_and_preprocess(same, {"validation": {"drop_duplicates": True}}).collect()}
    assert kept == {"Same": 0, "Other": 0}
    short = spark.createDataFrame([("Hi", 0), ("Hello world", 1), ("X", 0)], "text string, type int")
    out = validate_and_preprocess(short, {"validation": {"min_text_length": 3}}).collect()
    assert [r["text"] for r in out] == ["Hello world"]


def test_validation_aliases_and_nulls(spark):
    df = spark.createDataFrame([(1, "A @b", 1), (2, None, 0), (3, None, 1), (4, "x  y  z", 0)], "doc_id long, tweet string, target int")
    out = {r["doc_id"]: (r["text"], r["type"]) for r in validate_and_preprocess(df).collect()}
    assert out == {1: ("a", 1), 4: ("x y z", 0)}


def test_feature_engineering_filter_uses_raw_words(spark):
    df = spark.createDataFrame([("one two three @four",), ("one two three",)], "text string")
    out = apply_feature_engineering(df).collect()
    assert [(r["text"], r["text_words"]) for r in out] == [("one two three", 4)]
    assert apply_feature_engineering(df, min_words_on="clean").count() == 0


def test_dedup_with_one_text_in_a_third_of_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"))
    expect = {}
    for r in sorted(df.collect(), key=lambda r: r["doc_id"]):
        expect.setdefault(r["text"], r["doc_id"])
    got = {r["text"]: r["doc_id"] for r in Q.dedup_keep_first(df).collect()}
    assert got == expect


def test_duplicate_report_and_listing(spark):
    rows = [("a", " x "), ("a", "x"), ("a", None), ("a", "y"), ("b", "z")]
    df = spark.createDataFrame(rows, "source string, text string")
    rep = {r["source"]: r.asDict() for r in Q.duplicate_report(df).collect()}
    assert (rep["a"]["total"], rep["a"]["unique_texts"], rep["a"]["dup_texts"], rep["a"]["dup_rows"], rep["a"]["null_texts"]) == (4, 3, 1, 2, 1)
    assert rep["a"]["pct_dup"] == 25.0 and rep["a"]["status"] == "DUPLICATES" and rep["b"]["status"] == "OK"
    assert sorted(r["text"] for r in Q.duplicated_rows(df).collect()) == [" x ", "x"]


def test_overlap_of_empty_test(spark):
    df = spark.createDataFrame([("x",)], "text string")
    assert Q.text_overlap(df, df.limit(0)).first()["pct_of_test"] is None
    assert Q.text_overlap(df, df).first().asDict() == {"train_texts": 1, "test_texts": 1, "overlap": 1, "pct_of_test": 100.0}


def test_filters(spark):
    df = spark.createDataFrame([("Bad Word", 1), ("fine", 0), (None, 1)], "text string, type int")
    assert Q.search(df, "b.d", 1).count() == 1
    assert Q.search(df, "zzz").count() == 0
    runs = spark.createDataFrame([("a",), (None,), ("b",)], "emb string")
    assert Q.isin_or_null(runs, "emb", ["a"]).count() == 2
    assert Q.match_metadata(runs, {"emb": "a"}).count() == 1
    assert Q.match_metadata(runs, {"absent": 1}).count() == 0
    trials = spark.createDataFrame([("COMPLETE",), ("FAIL",)], "state string")
    assert Q.completed_trials(trials).count() == 1


@pytest.mark.parametrize("n", [1, 7, 500, 5000])
def test_sample_is_exact_and_reproducible(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    expect = sorted(range(1000), key=_key)[:n]
    assert sorted(r["doc_id"] for r in S.sample_n(df, n).collect()) == sorted(expect)


def test_split_is_exact_per_label(spark):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("type"))
    out = S.train_test_split(df, 0.2, stratify="type").collect()
    for label in (0, 1):
        ids = [r["doc_id"] for r in out if r["type"] == label]
        test = {r["doc_id"] for r in out if r["type"] == label and r["split"] == "test"}
        assert test == set(sorted(ids, key=_key)[: math.ceil(len(ids) * 0.2)])
    plain = Counter(r["split"] for r in S.train_test_split(df, 0.2).collect())
    assert plain["test"] == math.ceil(1003 * 0.2)
    loose = Counter(r["split"] for r in S.train_test_split(df, 0.2, exact=False).collect())
    assert 120 < loose["test"] < 280


def test_folds_are_balanced_and_keep_all_rows(spark):
    df = spark.range(103).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, None).when(F.col("id") % 4 == 0, 1).otherwise(0).alias("type"))
    out = S.assign_folds(df, 5).collect()
    assert len(out) == 103
    for label in (0, 1, None):
        sizes = Counter(r["fold"] for r in out if r["type"] == label)
        assert max(sizes.values()) - min(sizes.get(f, 0) for f in range(5)) <= 1


def test_many_strata_are_split_exactly(spark):
    """5,000 strata of four rows: each gives exactly its share to the test part."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 5000).alias("type"))
    out = S.train_test_split(df, 0.25, stratify="type")
    counts = out.groupBy("type").agg(F.sum((F.col("split") == "test").cast("int")).alias("test"), F.count("*").alias("n"))
    assert counts.count() == 5000 and counts.where("test <> 1 OR n <> 4").count() == 0


def test_folds_without_labels(spark):
    out = S.assign_folds(spark.range(11).withColumnRenamed("id", "doc_id"), 3, None).collect()
    assert sorted(Counter(r["fold"] for r in out).values()) == [3, 4, 4]


def test_running_values_equal_brute_force(spark):
    rows = [(i, (i * 7) % 5 if i % 3 else None, i // 10, "k" if i % 2 else None) for i in range(95)]
    df = spark.createDataFrame(rows, "i int, v int, b int, k string")
    values = {"mx": Running(F.col("v"), "max"), "prev": Running(F.col("v"), "last", inclusive=False), "n": Running(F.lit(1), "sum", inclusive=False)}
    out = running(df, values, ["i"], ["k"], partitions=7).collect()
    assert len(out) == 95
    seen = {}
    for r in sorted(out, key=lambda r: r["i"]):
        past = seen.setdefault(r["k"], [])
        known = [v for v in [*past, r["v"]] if v is not None]
        assert r["mx"] == (max(known) if known else None)
        assert r["prev"] == next((v for v in reversed(past) if v is not None), None)
        assert r["n"] == len(past)
        past.append(r["v"])


def test_a_busy_moment_is_spread(spark):
    """Half of all rows at one moment, and a hot key with two thirds of them: ranges stay even, values exact."""
    df = spark.range(4000).select(
        F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise(F.col("id") * 1.0).alias("t"),
        F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
    )
    for keys in ([], ["k"]):
        ranged = by_ranges(df, ["t", "i"], keys, partitions=20)
        sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
        assert len(sizes) == 20 and max(sizes) <= 2 * 4000 / 20
        got = scan(ranged, {"n": Running(F.lit(1), "sum"), "top": Running(F.col("i"), "max")}, ["t", "i"], keys).collect()
        seen = {}
        for r in sorted(got, key=lambda r: (r["t"], r["i"])):
            n, top = seen.get(r["k"] if keys else 0, (0, -1))
            seen[r["k"] if keys else 0] = (n + 1, max(top, r["i"]))
            assert (r["n"], r["top"]) == (n + 1, max(top, r["i"]))
