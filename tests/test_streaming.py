import datetime as dt
import random

from pyspark.sql import functions as F

from textguard.operators.models import predict
from textguard.operators.quality import dedup_keep_first
from textguard.operators.validate import apply_feature_engineering
from textguard.plans.train import train
from textguard.streaming.live import score_stream, write_scores
from textguard.streaming.lockout import LockoutRules, lockout, lockout_stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _brute(rows, limit, window, lock):
    """Outcome per event by replaying each user's attempts against the written rules."""
    out, fails, until = {}, {}, {}
    for event, user, sec, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        if user in until:
            if sec < until[user]:
                out[event] = "rejected"
                continue
            del until[user]
            fails[user] = []
        live = [s for s in fails.get(user, []) if sec - s < window]
        if len(live) >= limit:
            until[user], fails[user], out[event] = sec + lock, [], "rejected"
        elif ok:
            fails[user], out[event] = [], "accepted"
        else:
            fails[user] = live + [sec]
            out[event] = "failed"
    return out


def _attempts(spark, rows):
    data = [(e, u, START + dt.timedelta(seconds=s), ok) for e, u, s, ok in rows]
    return spark.createDataFrame(data, "event_id long, user_id string, ts timestamp, ok boolean")


def _random_attempts(seed=0):
    rng, rows, at = random.Random(seed), [], 0
    for event in range(1500):
        at += rng.choice([5, 20, 60, 200]) if event % 200 else 8000
        user = "hot" if rng.random() < 0.5 else f"u{rng.randrange(6)}"
        rows.append((event, user, at, rng.random() < 0.15))
    return rows


def test_five_failures_lock_for_a_quarter_hour(spark):
    rows = [(i, "a", 10 * i, False) for i in range(5)] + [
        (5, "a", 60, True),  # correct, but it is the attempt that triggers the lock
        (6, "a", 900, True),  # still locked
        (7, "a", 961, True),  # lock is over
        (8, "b", 0, True),
    ]
    got = {r["event_id"]: r["outcome"] for r in lockout(_attempts(spark, rows)).collect()}
    assert [got[i] for i in range(9)] == ["failed"] * 5 + ["rejected", "rejected", "accepted", "accepted"]


def test_batch_equals_replay(spark):
    rows = _random_attempts()
    for limit, window, lock in ((5, 3600, 900), (3, 500, 2000)):
        got = {r["event_id"]: r["outcome"] for r in lockout(_attempts(spark, rows), LockoutRules(limit, window, lock)).collect()}
        expect = _brute(rows, limit, window, lock)
        assert got == expect and "rejected" in set(expect.values())


def test_missing_users_are_kept(spark):
    rows = [(1, None, 0, False), (2, "a", 0, True)]
    assert lockout(_attempts(spark, rows)).count() == 2


def _judged(spark, tmp_path, batches, delay):
    source = str(tmp_path / "in")
    for rows in batches:
        _attempts(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id long, user_id string, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).parquet(source)
        query = (
            lockout_stream(stream, delay=delay).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
    return {r["event_id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_shuffled_stream_equals_batch(spark, tmp_path):
    """Attempts arrive out of order inside the watermark, over restarts: the outcomes are those of the batch form."""
    rows = _random_attempts(1)[:600]
    rng = random.Random(7)
    late = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 1500))
    assert late != rows
    end = max(r[2] for r in rows)
    batches = [late[:250], late[250:], [(9999, "closing", end + 10_000_000, True)]]
    got = _judged(spark, tmp_path, batches, "1500 seconds")
    got.pop(9999, None)
    assert got == _brute(rows, 5, 3600, 900) and "rejected" in got.values()


def test_live_scoring_equals_batch(spark, tmp_path):
    texts = ["stupid awful loser go away", "lovely sunny day my friend", "some other words appear here", "too short"]
    corpus = spark.createDataFrame([(i, texts[i % 2] + f" n{i % 5}", (i + 1) % 2) for i in range(80)], "doc_id long, text string, type int")
    model = train(corpus, "tfidf", ["logistic_regression"], {"logistic_regression": {"max_iter": 10}}, max_features=20)
    pipeline = model.deployable("logistic_regression")
    fresh = spark.createDataFrame([(i, texts[i % 4] + (" Extra" if i >= 8 else "")) for i in range(12)], "doc_id long, text string")
    fresh.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fresh.schema).parquet(str(tmp_path / "in"))
    query = write_scores(score_stream(stream, pipeline, 0.6), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination(180)
    got = {(r["text"], r["pred"], round(r["proba"], 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = predict(apply_feature_engineering(dedup_keep_first(fresh)), pipeline, 0.6)
    assert got == {(r["text"], r["pred"], round(r["proba"], 9)) for r in batch.collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count() == 6
    assert batch.where(F.col("pred") == 1).count() >= 1
