"""CBOW vectors, and fitted text stages that survive saving."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from textguard.operators import cbow
from textguard.operators.models import predict
from textguard.operators.vectorize import hashing_encoder
from textguard.operators.word_models import EncoderModel, WordVectorModel, factory_path
from textguard.plans.featurise import fit_vectorizer
from textguard.plans.train import train
from textguard.sources.registry import load_model

GROUPS = ["cat dog pet fur paw", "sun moon star sky orbit", "bread milk egg butter flour"]
BAD, GOOD = "stupid awful loser hate ugly", "lovely sunny friend kind happy"


def corpus(spark, n=90):
    rows = [(i, (BAD if i % 2 else GOOD) + f" filler{i % 7} Extra", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, type int")


def topics(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, " ".join(rng.choice(GROUPS[k % 3].split(), 12))) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_cbow_recovers_groups_across_blocks(spark):
    docs = topics(spark)
    vectors = cbow.train_cbow(docs, vector_size=12, epochs=8, sample=0, rate=0.1, block_words=1500, noise_words=60).collect()
    v = {r["word"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in vectors}
    assert len(v) == 15
    own = [v[a] @ v[b] for g in GROUPS for a in g.split() for b in g.split() if a < b]
    other = [v[a] @ v[b] for g in GROUPS for h in GROUPS if g != h for a in g.split() for b in h.split()]
    assert min(own) > max(other)


def test_cbow_spreads_with_the_input(spark):
    docs = topics(spark, 300)
    texts, blocks = cbow.sentences(docs, "text", 500)
    sizes = {r["block"]: r["n"] for r in texts.groupBy("block").agg(F.sum(F.size("codes")).alias("n")).collect()}
    assert blocks == 8 and len(sizes) == 8 and max(sizes.values()) < 2 * 3600 / 8
    long, _ = cbow.sentences(spark.createDataFrame([(1, "w " * 2500)], "doc_id long, text string"), "text", 1000)
    assert sorted(len(r["codes"]) for r in long.collect()) == [500, 1000, 1000]


def test_cbow_words_and_reruns(spark):
    docs = spark.createDataFrame([(1, "a a b b c"), (2, None), (3, ""), (4, "B \t b")], "doc_id long, text string")
    first = {r["word"]: list(r["vector"]) for r in cbow.train_cbow(docs, vector_size=5, epochs=3).collect()}
    again = {r["word"]: list(r["vector"]) for r in cbow.train_cbow(docs, vector_size=5, epochs=3).collect()}
    assert set(first) == {"a", "b"} and first == again
    assert cbow.train_cbow(docs.where("doc_id = 2"), vector_size=5).count() == 0


def test_cbow_leaves_one_parameter_table(spark):
    """A table of parameters goes when the next one is written, and the changes' shuffle files go with it."""
    import glob

    from textguard.session import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    left = []
    for epochs in (1, 6):
        before = set(glob.glob(f"{folder}/table-*"))
        cbow.train_cbow(topics(spark, 60), vector_size=4, epochs=epochs, block_words=100, noise_words=20).count()
        left.append(len(set(glob.glob(f"{folder}/table-*")) - before))
    assert left[0] == left[1]


@pytest.mark.parametrize("homes", [1, 8])
def test_cbow_homes_do_not_change_the_vectors(spark, monkeypatch, homes):
    """Every block starts from the same vectors, whether it shares a home or not."""
    docs = topics(spark, 300)
    options = {"vector_size": 6, "epochs": 2, "sample": 0, "block_words": 60, "noise_words": 10}
    monkeypatch.setattr(cbow, "HOME_BLOCKS", 3)
    monkeypatch.setattr(cbow, "SHARD_ROWS", 40)
    want = {r["word"]: r["vector"] for r in cbow.train_cbow(docs, **options).collect()}
    monkeypatch.setattr(cbow, "HOME_BLOCKS", homes)
    got = {r["word"]: r["vector"] for r in cbow.train_cbow(docs, **options).collect()}
    assert set(got) == set(want) and all(np.allclose(got[w], want[w], atol=1e-5) for w in want)


def test_descent_lowers_the_loss():
    """A pass moves the score of true words up and that of noise words down."""
    rng = np.random.default_rng(0)
    texts = [np.array([0, 1] * 20), np.array([2, 3] * 20)]
    vec_in, vec_out = rng.normal(scale=0.1, size=(4, 8)), np.zeros((4, 8))
    for _ in range(60):
        cbow.descend(texts, vec_in, vec_out, np.ones(4), np.arange(4), 2, 3, 0.1, rng)
    score = vec_in @ vec_out.T
    assert score[0, 1] > score[0, 2] + 1 and score[2, 3] > score[2, 0] + 1


@pytest.mark.parametrize("method", ["tfidf", "word2vec", "glove", "glove_file", "bert"])
def test_saved_pipelines_score_raw_text(spark, tmp_path, method):
    options = {"stop_words": None}
    if method == "glove_file":
        path = tmp_path / "v.txt"
        path.write_text("".join(f"{w} {float(w in BAD)} {float(w in GOOD)} 0.5\n" for w in f"{BAD} {GOOD}".split()))
        options["glove_path"] = str(path)
    elif method == "bert":
        options |= {"encoder": hashing_encoder, "encoder_args": {"size": 48}}
    elif method != "tfidf":
        options |= {"vector_size": 6, "training": {"epochs": 8, "sample": 0} if method == "word2vec" else {"sweeps": 3}}
    docs = corpus(spark)
    result = train(docs, method.split("_")[0], ["logistic_regression"], {"logistic_regression": {"max_iter": 30}}, max_features=50,
                   registry_root=str(tmp_path / "models"), save_model="logistic_regression", **options)
    loaded = load_model(spark, str(tmp_path / "models"), result.model_id)
    assert isinstance(loaded, PipelineModel)
    fresh = spark.createDataFrame([(1, "stupid loser"), (2, "kind happy friend"), (3, None), (4, "unseen")], "doc_id long, text string")
    mine = {r["doc_id"]: (r["pred"], r["proba"]) for r in predict(fresh, result.deployable("logistic_regression")).collect()}
    theirs = {r["doc_id"]: (r["pred"], r["proba"]) for r in predict(fresh, loaded).collect()}
    assert mine == theirs and len(mine) == 4
    if method != "word2vec":
        assert (mine[1][0], mine[2][0]) == (1, 0)


def test_only_the_training_part_is_seen(spark):
    """A word of the test part alone is unknown to the vectorizer, for every method that learns words."""
    docs = corpus(spark)
    marked = train(docs, "word2vec", ["logistic_regression"], {"logistic_regression": {"max_iter": 5}}, vector_size=4, training={"epochs": 1})
    from textguard.operators.sampling import train_test_split

    parts = train_test_split(docs, 0.2)
    secret = parts.withColumn("text", F.when(F.col("split") == "test", F.concat("text", F.lit(" secret secret"))).otherwise(F.col("text"))).drop("split")
    for fit_on, known in (("train", False), ("all", True)):
        got = train(secret, "word2vec", ["logistic_regression"], {"logistic_regression": {"max_iter": 5}}, fit_on=fit_on, vector_size=4, training={"epochs": 1})
        assert (got.vectorizer.words.where("word = 'secret'").count() > 0) is known
    assert marked.vectorizer.words.count() > 0
    with pytest.raises(ValueError):
        train(docs, "word2vec", ["logistic_regression"], fit_on="test")


def test_encoders_without_a_path_are_not_saved(spark, tmp_path):
    model = fit_vectorizer(corpus(spark), "bert", encoder=hashing_encoder(8))
    assert model.transform(corpus(spark)).select("features").first()[0].size == 8
    with pytest.raises(ValueError):
        model.write().save(str(tmp_path / "m"))
    assert factory_path(hashing_encoder) == "textguard.operators.vectorize:hashing_encoder" and factory_path(hashing_encoder(4)) == ""
    EncoderModel.of(hashing_encoder, {"size": 8}).write().overwrite().save(str(tmp_path / "e"))
    loaded = EncoderModel.load(str(tmp_path / "e"))
    a, b = (m.transform(corpus(spark)).orderBy("doc_id").first()["features"] for m in (model, loaded))
    assert np.allclose(a.toArray(), b.toArray())


def test_word_model_overwrites(spark, tmp_path):
    words = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<float>")
    model = WordVectorModel(words, aggregation="sum")
    model.write().save(str(tmp_path / "w"))
    model.write().overwrite().save(str(tmp_path / "w"))
    loaded = WordVectorModel.load(str(tmp_path / "w"))
    assert loaded.getOrDefault("aggregation") == "sum" and loaded.uid == model.uid
    got = loaded.transform(spark.createDataFrame([("A a b",), (None,)], "text string")).collect()
    assert [r["features"].toArray().tolist() for r in got] == [[2.0, 4.0], [0.0, 0.0]]
