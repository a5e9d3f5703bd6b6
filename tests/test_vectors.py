import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textguard.errors import UnknownMethodError
from textguard.functions.vectors import classify_logits, l2_normalize
from textguard.operators import aggregate_vectors as A
from textguard.operators import cooccurrence as C
from textguard.operators import vectorize as V
from textguard.operators.cbow import train_cbow
from textguard.plans.featurise import embed, featurise

CORPUS = [
    "red apple red pear", "green apple and green pear", "the apple fell on the pear", "blue sky over red apple",
    "sky and sea", "sea sky blue blue", "apple", "", None,
]
STOP = ["the", "and", "on"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string").repartition(3)


def _terms(text, low=1, high=2, width=2):
    tok = [t for t in re.findall(r"\w{%d,}" % width, (text or "").lower()) if t not in STOP]
    return [" ".join(tok[i : i + n]) for n in range(low, high + 1) for i in range(len(tok) - n + 1)]


def _expected_tfidf(k):
    rows = [Counter(_terms(t)) for t in CORPUS]
    n = len(rows)
    df = Counter(t for r in rows for t in r)
    tot = Counter()
    for r in rows:
        tot.update(r)
    kept = [t for t in df if 2 <= df[t] <= 0.95 * n]
    vocab = sorted(sorted(kept, key=lambda t: (-tot[t], t))[:k])
    out = np.zeros((n, len(vocab)))
    for i, r in enumerate(rows):
        for j, t in enumerate(vocab):
            out[i, j] = r[t] * (math.log((1 + n) / (1 + df[t])) + 1)
        norm = np.linalg.norm(out[i])
        out[i] /= norm if norm else 1
    return vocab, out


def test_tfidf_equals_plain_python_and_survives_saving(spark, docs, tmp_path):
    model = V.TextVectorizer("tfidf", max_features=6, stop_words=STOP).fit(docs)
    vocab, expect = _expected_tfidf(6)
    assert V.terms_of(model) == vocab
    model.write().overwrite().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        got = m.transform(docs).select("doc_id", vector_to_array("features").alias("v")).orderBy("doc_id").collect()
        assert np.allclose([r["v"] for r in got], expect)
    unseen = spark.createDataFrame([(1, "apple zebra")], "doc_id long, text string")
    v = model.transform(unseen).first()["features"]
    assert v.numNonzeros() == 1 and v[vocab.index("apple")] == pytest.approx(1.0)


def test_no_term_left(spark):
    with pytest.raises(ValueError):
        V.TextVectorizer("bow", stop_words=STOP).fit(spark.createDataFrame([(1, "once")], "doc_id long, text string"))


def test_cooccurrence_equals_matrix_product(docs, monkeypatch):
    rows = [Counter(_terms(t, 1, 1, 1)) for t in CORPUS]
    df = Counter(t for r in rows for t in r)
    vocab = sorted(t for t in df if 2 <= df[t] <= 0.95 * len(rows))
    x = np.array([[r[t] for t in vocab] for r in rows])
    expect = {(a, b): v for i, a in enumerate(vocab) for j, b in enumerate(vocab) if i != j and (v := int((x.T @ x)[i, j]))}
    for size, buffer in ((128, 4_000_000), (2, 3)):  # long documents: several slices and buffers
        monkeypatch.setattr(C, "SLICE", size)
        monkeypatch.setattr(C, "BUFFER", buffer)
        got = C.cooccurrence(docs, stop_words=STOP).collect()
        assert len(got) == len(expect)
        assert {(r["w1"], r["w2"]): r["x"] for r in got} == expect


def test_cooccurrence_shuffles_counts_not_products(spark, monkeypatch):
    """Sums are final where they are made, however many term groups there are; ids may be null or repeat, and no exchange carries pairs."""
    texts = [(i % 40 if i % 7 else None, " ".join(f"w{(i * i + 3 * k) % 30} w{k % 4}" for k in range(i % 9))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    df, by_id = Counter(), {}
    for i, t in texts:
        df.update(set(t.split()))
        by_id.setdefault(i, Counter()).update(t.split())
    vocab = {w for w, n in df.items() if 2 <= n <= 0.95 * len(texts)}
    expect = Counter()
    for row in by_id.values():
        expect.update({(a, b): row[a] * row[b] for a in row for b in row if a != b and {a, b} <= vocab})
    for cells in (4_000_000, 20):
        monkeypatch.setattr(C, "GROUP_CELLS", cells)
        out = C.cooccurrence(docs, stop_words=None)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan.split("MapInArrow")[0]
        rows = out.collect()
        assert {(r["w1"], r["w2"]): r["x"] for r in rows} == expect and len(rows) == len(expect)
        half = C.cooccurrence(docs, stop_words=None, mirror=False).collect()
        assert {(r["w1"], r["w2"]): r["x"] for r in half} == {k: x for k, x in expect.items() if k[0] < k[1]} and 2 * len(half) == len(rows)
    assert C.cooccurrence(docs.where("text is null")).count() == 0


def test_glove_loss_falls_and_recovers_groups(spark, monkeypatch):
    groups = ["cat dog pet", "sun moon star", "bread milk egg"]
    texts = [(i, f"{groups[i % 3]} {groups[i % 3]}" + (" common" if i % 2 else " usual")) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cells = C.cooccurrence(docs, stop_words=None)
    vectors, losses = C.train_glove(cells, size=4, sweeps=4, with_loss=True)
    assert losses[-1] <= losses[0] and losses[-1] < 5.0
    v = {r["word"]: np.array(r["vector"]) for r in vectors.collect()}
    assert len(v) == 11
    monkeypatch.setattr(C, "GROUP_ROWS", 2)  # neighbours of a word split over several groups
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)  # and the other side joined instead of broadcast
    split, split_losses = C.train_glove(cells, size=4, sweeps=4, with_loss=True)
    assert split_losses == pytest.approx(losses, rel=1e-6)


@pytest.mark.parametrize("method", A.METHODS)
def test_document_vectors_both_ways(spark, docs, method):
    words = spark.createDataFrame(
        [("red", [1.0, -2.0]), ("apple", [0.5, 4.0]), ("sky", [3.0, 0.0]), ("blue", [-1.0, 1.0])], "word string, vector array<float>"
    )
    table = {r["word"]: np.array(r["vector"]) for r in words.collect()}
    small = A.document_vectors(docs, words, method).orderBy("doc_id").collect()
    joined = A.document_vectors(docs, words, method, broadcast_bytes=0).orderBy("doc_id").collect()
    for i, text in enumerate(CORPUS):
        m = np.array([table[w] for w in (text or "").lower().split() if w in table])
        if len(m) == 0:
            expect = np.zeros(2)
        elif method == "mean_top_3":
            expect = np.sort(m, axis=0)[-min(3, len(m)) :].mean(axis=0)
        else:
            expect = getattr(np, method)(m, axis=0)
        assert np.allclose(small[i]["vector"], expect) and np.allclose(joined[i]["vector"], expect)
    with pytest.raises(UnknownMethodError):
        A.document_vectors(docs, words, "mode")


def test_exact_median_with_hot_groups_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(v)) for v in rng.integers(0, 4, 3001)] + [("cold", float(v)) for v in rng.normal(size=500)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["value"] for r in A.exact_median(df, ["k"], "v", accuracy=20).collect()}
    for k in ("hot", "cold", "one"):
        assert got[k] == pytest.approx(np.median([v for g, v in rows if g == k]))


def test_word2vec_skips_rare_words(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma" + (" rare" if i == 0 else "")) for i in range(30)], "doc_id long, text string")
    words = train_cbow(docs, vector_size=4, epochs=1)
    assert {r["word"] for r in words.collect()} == {"alpha", "beta", "gamma"}
    out = A.document_vectors(docs, words, "mean").orderBy("doc_id").collect()
    assert np.allclose(out[0]["vector"], out[1]["vector"])  # an unknown word does not dilute the mean


def test_encoder_batches_are_normalised(docs):
    out = V.embed_batch(docs, V.hashing_encoder(16), batch_size=2).collect()
    assert len(out) == len(CORPUS)
    for r in out:
        norm = np.linalg.norm(r["vector"])
        assert len(r["vector"]) == 16 and (norm == pytest.approx(1.0) or not (r["text"] or "").split())


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],), ([0.0, 0.0],)], "v array<float>")
    rows = df.select(classify_logits("v").alias("c"), l2_normalize("v").alias("n")).collect()
    assert rows[0]["c"]["label"] == 1 and rows[0]["c"]["confidence"] == pytest.approx(1 / (1 + math.exp(-1)))
    assert rows[1]["c"]["label"] == 0 and rows[1]["n"] == [0.0, 0.0]


@pytest.mark.parametrize("method", ["bow", "word2vec", "glove", "bert"])
def test_dispatcher(spark, docs, method, tmp_path):
    if method == "glove":
        (tmp_path / "v.txt").write_text("red 1 0\nsky 0 1\n")
    out = embed(
        docs, method, vector_size=4, glove_path=str(tmp_path / "v.txt") if method == "glove" else None,
        encoder=V.hashing_encoder(8), stop_words=STOP, cache_root=str(tmp_path / "cache"), encoder_key="hashing-8",
    )
    assert out.count() == len(CORPUS) and out.schema["features"].dataType.typeName() == "vectorudt"
    with pytest.raises(UnknownMethodError):
        embed(docs, "doc2vec")


def test_featurise_writes_a_partition(spark, docs, tmp_path):
    featurise(docs.where("text IS NOT NULL"), "bow", str(tmp_path / "f"), max_features=5, stop_words=STOP)
    back = spark.read.parquet(str(tmp_path / "f")).where(F.col("embedding") == "bow")
    assert "text_words" in back.columns and back.count() == sum(len((t or "").split()) > 3 for t in CORPUS)


def test_sequence_classifier_batches(docs):
    def make():
        return lambda texts: np.array([[0.0, float("red" in str(t))] for t in texts], dtype="float32")

    for r in V.classify_batch(docs, make, batch_size=4).collect():
        hit = "red" in (r["text"] or "")
        assert r["pred"] == int(hit) and sum(r["probs"]) == pytest.approx(1.0)
        assert r["confidence"] == pytest.approx(1 / (1 + math.exp(-1)) if hit else 0.5)


def test_only_ngrams_of_frequent_words_are_counted(spark):
    """The vocabulary is that of all n-grams, from far fewer counted terms; ties at the bound and frequent words of one text stay."""
    rows = [(i, " ".join(f"w{(i * k) % (3 + k)} rare{i}x{k} ww{k % 3}" for k in range(12)) + " solo" * 40 * (i == 3)) for i in range(40)]
    docs = spark.createDataFrame([*rows, (90, None)], "doc_id long, text string")
    full = V.SQLTransformer(statement=V.terms_sql("text", (), (1, 2))).transform(docs).select(V.TERMS)
    single = V.SQLTransformer(statement=V.terms_sql("text", (), (1, 1))).transform(docs).select(V.TERMS)
    for n in (1, 3, 5, 8, 30, 5000):
        some = V.frequent_ngrams(single, V.TERMS, 2, 2, 0.95, n)
        a, b = (V.vocabulary(d, V.TERMS, 2, 0.95, n).collect() for d in (full, some))
        assert a == b
        if n < 8:
            size = lambda d: d.agg(F.sum(F.size(V.TERMS))).first()[0]
            assert size(some) < size(full) / 2


def test_only_words_of_the_texts_are_shipped(spark, docs, monkeypatch):
    words = spark.range(2000).select(F.concat(F.lit("other"), "id").alias("word"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    words = words.union(spark.createDataFrame([("red", [1.0, -2.0]), ("apple", [0.5, 4.0])], "word string, vector array<double>"))
    plain = {r["doc_id"]: r["vector"] for r in A.document_vectors(docs, words).collect()}
    monkeypatch.setattr(A, "LOOKUP_BYTES", 100)
    out = A.document_vectors(docs, words, broadcast_bytes=1000)  # all words need more, those of the texts less
    assert "MapInPandas" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["vector"] for r in out.collect()} == plain


def test_cooccurrence_keeps_one_copy_of_the_counts(spark, monkeypatch):
    """However many groups and words there are, nothing is exchanged after the counts are packed, and a count is packed once."""
    texts = [(f"d{i % 50}" if i % 9 else None, " ".join(f"w{(i * i + 3 * k) % 40} w{k % 5}" for k in range(12))) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    df, by_id = Counter(), {}
    for i, t in texts:
        df.update(set(t.split()))
        by_id.setdefault(i, Counter()).update(t.split())
    vocab = {w for w, n in df.items() if 2 <= n <= 0.95 * len(texts)}
    expect = Counter()
    for row in by_id.values():
        expect.update({(a, b): row[a] * row[b] for a in row for b in row if a != b and {a, b} <= vocab})
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(C, "GROUP_CELLS", 100)
    out = C.cooccurrence(docs, stop_words=None)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["w1"], r["w2"]): r["x"] for r in out.collect()} == expect
    packed = [r for made in _packed_counts(docs, vocab, groups=7) for r in made]
    assert len(packed) == len(set(packed)) == sum(len(set(row) & vocab) for row in by_id.values())


def _packed_counts(docs, vocab, groups):
    spark = docs.sparkSession
    codes = docs.select(F.xxhash64("doc_id").alias("doc"), F.transform(F.split("text", " "), lambda t: F.xxhash64(t)).alias("codes"))
    parts = codes.mapInArrow(C._deal(groups), "doc long, part long, codes array<long>, counts array<int>")
    names = spark.createDataFrame([(w,) for w in sorted(vocab)], "term string").withColumn("code", F.xxhash64("term"))
    parts = parts.unionByName(names.withColumn("part", F.pmod("code", F.lit(groups))), allowMissingColumns=True)
    keyed = parts.repartition(groups, C._own_partitions(spark, groups))
    assert keyed.select("part", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().agg(F.max("count")).first()[0] == 1
    for r in keyed.sortWithinPartitions("part").mapInArrow(C._packed, "part long, names binary, rows binary").collect():
        rows, names = (C._unpack(pa.scalar(bytes(r[c]))) for c in ("rows", "names"))
        yield [(d["doc"], names.column("term")[i].as_py()) for d in rows.to_pylist() for i in d["ids"]]


def test_many_vectors_stay_off_the_driver(spark):
    """A table of some ten thousand vectors is joined by default, not collected and shipped; texts need no id for it."""
    words = spark.range(40_000).select(F.concat(F.lit("w"), "id").alias("word"), F.array_repeat((F.col("id") / 7).cast("float"), 100).alias("vector"))
    docs = spark.range(41).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.concat(F.lit("W"), k + F.col("id") * 1000))).alias("text"))
    docs = docs.union(spark.createDataFrame([(None,), ("w1 w3 unknown w3",)], "text string"))
    out = A.document_vectors(docs, words)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == ["text", "vector"]
    expect = A.document_vectors(docs, words, broadcast_bytes=1 << 30)
    assert "MapInPandas" in expect._jdf.queryExecution().executedPlan().toString()
    got, want = ({r["text"]: r["vector"] for r in d.collect()} for d in (out, expect))
    assert len(got) == 43 and got == want and want["w1 w3 unknown w3"][0] == pytest.approx(1 / 3)
