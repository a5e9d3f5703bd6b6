import os

import pytest
from pyspark.sql import functions as F

from textguard.errors import ColumnNotFoundError, InvalidBinaryLabelError
from textguard.operators.metrics import classification_report
from textguard.plans.prepare import duplicate_audit, prepare, recap
from textguard.sources import normalise, readers, writers
from textguard.sources import schema as S


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_unrecognised_csv_raises(spark, tmp_path):
    with pytest.raises(ColumnNotFoundError):
        readers.read_labelled(spark, _write(tmp_path / "a.csv", "x,y\n1,0\n"))


def test_csv_with_quoted_line_breaks_and_missing_cells(spark, tmp_path):
    path = _write(tmp_path / "a.csv", 'text,type\n"two\nlines, ""quoted""",1\nplain text,0\nNA,1\nno label,\n')
    rows = {r["text"]: r["type"] for r in readers.read_labelled(spark, path).collect()}
    assert rows == {'two\nlines, "quoted"': 1, "plain text": 0}


@pytest.mark.parametrize(
    "content,expect",
    [
        ("tweet_text,cyberbullying_type\nhello there,not_cyberbullying\nbad stuff,age\n", {"hello there": 0, "bad stuff": 1}),
        ("content,oh_label\nhello there,1\nother one,0\n", {"hello there": 1, "other one": 0}),
        ("text,label\nhello there,Not_Cyberbullying\nbad stuff,gender\n", {"hello there": 0, "bad stuff": 1}),
        ("text,label\nhello there,0\nbad stuff,1\n", {"hello there": 0, "bad stuff": 1}),
        ("text,label\nhello there,not_sarcasm\nbad stuff,SARCASM\n", {"hello there": 0, "bad stuff": 1}),
        ("Direct_Post_1,type\nabc,1\n", {"abc": 1}),
        ("text,message,type\nab,hello there,1.0\n", {"hello there": 1}),
    ],
)
def test_source_shapes(spark, tmp_path, content, expect):
    rows = readers.read_labelled(spark, _write(tmp_path / "a.csv", content)).collect()
    assert {r["text"]: r["type"] for r in rows} == expect


def test_labels_that_are_not_binary(spark, tmp_path):
    with pytest.raises(InvalidBinaryLabelError):
        readers.read_labelled(spark, _write(tmp_path / "a.csv", "text,oh_label\nhello there,3\n"))


def test_explicit_columns(spark, tmp_path):
    path = _write(tmp_path / "a.csv", "q,r\nhello there,ok\nbad stuff,no\n")
    rows = readers.read_labelled(spark, path, text_col="q", label_col="r", negative_class="OK").collect()
    assert {r["text"]: r["type"] for r in rows} == {"hello there": 0, "bad stuff": 1}
    with pytest.raises(ColumnNotFoundError):
        readers.read_labelled(spark, path, text_col="zz")


def test_sarcasm(spark, tmp_path):
    path = _write(tmp_path / "s.csv", "response,label\nsure thing,SARCASM\nplain words,NOT_SARCASM\nabc,SARCASM\n")
    rows = readers.read_sarcasm(spark, path).collect()
    assert {r["text"]: r["type"] for r in rows} == {"sure thing": 1, "plain words": 0}


def test_read_many_skips_and_caps(spark, tmp_path):
    good = _write(tmp_path / "g.csv", "text,type\n" + "".join(f"row number {i},{i % 2}\n" for i in range(50)))
    other = _write(tmp_path / "h.csv", "text,type\nanother row,1\n")
    bad = _write(tmp_path / "b.csv", "x,y\n1,0\n")
    corpus, errors = readers.read_many(spark, [good, bad, str(tmp_path / "missing.csv"), other], n_samples=20)
    assert {r["source"]: r["count"] for r in corpus.groupBy("source").count().collect()} == {"g.csv": 20, "h.csv": 1}
    assert corpus.select("doc_id").distinct().count() == 21
    assert errors.count() == 2
    with pytest.raises(ValueError):
        readers.read_many(spark, [bad])


def test_prepare_and_audit(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "text,type\nHello @you there,0\nHello @you there,1\nsecond text,1\n")
    b = _write(tmp_path / "b.csv", "text,type\nsecond text,1\nthird text,0\n")
    corpus, errors = prepare(spark, [a, b])
    assert sorted((r["text"], r["type"]) for r in corpus.collect()) == [("hello there", 0), ("second text", 1), ("third text", 0)]
    assert errors.isEmpty()
    report, shared = duplicate_audit(spark, [a, b], overlap=(a, b))
    assert {r["source"]: r["dup_rows"] for r in report.collect()} == {"a.csv": 2, "b.csv": 0}
    assert shared.first()["overlap"] == 1 and shared.first()["pct_of_test"] == 50.0


def test_majority_ties_go_to_the_first(spark):
    df = spark.createDataFrame([([1, 2, 2],), ([0, 2],), ([2, 0],), ([],), (None,)], "v array<int>")
    got = [(r[0], r[1]) for r in df.select(S.majority("v"), S.majority_label("v")).collect()]
    assert got == [(2, 0), (0, 1), (2, 0), (None, 0), (None, 0)]


def test_normalise_sources_and_write(spark, tmp_path):
    auto = spark.createDataFrame([("hello there", "0"), ("bad stuff", "1")], "text string, label string")
    guessed = spark.createDataFrame([("some quite long text for the guess", 0), ("another long text for guessing", 3)], "body string, cls int")
    comments = spark.createDataFrame([("a comment", 2), ("abc", 0)], "comment_text string, label int")
    voted = spark.createDataFrame([(["so", "nice"], ([2, 2, 1],)), (["so", "bad"], ([1],))], "post_tokens array<string>, annotators struct<label:array<int>>")
    out = normalise.normalise_sources(
        {"x": ("auto", {"train": auto}), "y": ("auto", {"train": guessed}), "z": ("comments", {"train": comments}), "v": ("annotated", {"test": voted})}
    )
    writers.write_normalised(out, str(tmp_path / "n"))
    rows = {r["text"]: (r["source"], r["split"], r["type"]) for r in spark.read.parquet(str(tmp_path / "n")).collect()}
    assert rows == {
        "hello there": ("x", "train", 0), "bad stuff": ("x", "train", 1),
        "some quite long text for the guess": ("y", "train", 0), "another long text for guessing": ("y", "train", 1),
        "a comment": ("z", "train", 1), "so nice": ("v", "test", 0), "so bad": ("v", "test", 1),
    }
    assert normalise.normalise_auto(spark.createDataFrame([(1, 2)], "a int, b int")).isEmpty()


def test_processed_tables_replace_one_partition(spark, tmp_path):
    root = str(tmp_path / "p")
    df = spark.createDataFrame([(1, [0.5])], "doc_id long, v array<double>")
    writers.write_processed(df, root, "bow")
    writers.write_processed(df, root, "tfidf")
    writers.write_processed(df.union(df), root, "bow")
    assert readers.read_processed(spark, root, "bow").count() == 2
    assert readers.read_processed(spark, root, "tfidf").count() == 1
    assert readers.read_processed(spark, root, "glove") is None
    assert readers.read_processed(spark, str(tmp_path / "none"), "bow") is None
    assert readers.feature_columns(spark.createDataFrame([(1, 2, 3)], "text_bow_0 int, text_bow_1 int, type int"), "bow") == ["text_bow_0", "text_bow_1"]


def test_word_vector_file(spark, tmp_path):
    path = _write(tmp_path / "v.txt", "the 0.5 -1.0\ncat 1e-1  2\n\n")
    rows = {r["word"]: r["vector"] for r in readers.read_word_vectors(spark, path).collect()}
    assert rows == {"the": [0.5, -1.0], "cat": [pytest.approx(0.1), 2.0]}


def test_reports_round_trip(spark, tmp_path):
    scored = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (0, 0)], "type int, pred int")
    rep = classification_report(scored)
    for model, emb in (("logistic_regression", "roberta"), ("svm", "bert")):
        writers.write_report_csv(rep, str(tmp_path), model, emb)
        writers.write_report(rep, str(tmp_path / "table"), model, emb)
    writers.write_report(rep, str(tmp_path / "table"), "svm", "bert")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 10
    rows, pivot = recap(spark, str(tmp_path / "*_report.csv"))
    got = {(r["model"], r["embedding"]): (r["accuracy"], r["recall"]) for r in rows.collect()}
    assert got == {("logistic_regression", "roberta"): (0.8, 1.0), ("svm", "bert"): (0.8, 1.0)}
    assert pivot.count() == 2
    p, r = 2 / 3, 1.0
    assert rows.first()["f1"] == pytest.approx(2 * p * r / (p + r))


def test_cache_key_sees_text_boundaries_and_params(spark, tmp_path):
    calls = []

    def build(df):
        calls.append(1)
        return df.withColumn("n", F.length("text"))

    one = spark.createDataFrame([(1, "ab"), (2, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a"), (2, "bc")], "doc_id long, text string")
    root = str(tmp_path / "cache")
    for df, params in ((one, {"k": 1}), (one, {"k": 1}), (one.orderBy(F.desc("doc_id")), {"k": 1}), (two, {"k": 1}), (one, {"k": 2})):
        out = writers.cached_embedding(df, "m", params, build, root)
        assert out.count() == 2
    assert len(calls) == 3
    writers.cached_embedding(one, "m", {"k": 1}, build, root, retrain=True)
    assert len(calls) == 4
