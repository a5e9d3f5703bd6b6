"""Quality classifier: gated attention over the encoded passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.language_id import fold
from textguard.llm.ngrams import char_ngrams

PASSAGE_CHARS = 600
HASHED = 128
SAMPLE_PER_CLASS = 3000
MAX_PASSAGES = 4096
HIDDEN = 24
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")
N_SHAPE = 12
WIDTH = N_SHAPE + HASHED


def passages(text: str, size: int = PASSAGE_CHARS) -> list[str]:
    """Consecutive passages of about ``size`` characters that together are the whole text."""
    n = max(1, round(len(text) / size))
    return [text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n)]


def encode(passage: str) -> np.ndarray:
    """Shape statistics of a passage and its hashed character bigrams."""
    words = _WORD.findall(passage)
    n, chars = max(1, len(words)), max(1, len(passage))
    lower = [w.lower() for w in words]
    pairs = list(zip(lower, lower[1:]))
    lines = [x for x in passage.split("\n") if x.strip()]
    x = np.zeros(WIDTH, np.float32)
    x[:N_SHAPE] = (
        np.log1p(len(words)) / 5,
        sum(map(len, words)) / n / 10,
        len(set(lower)) / n,
        len(set(pairs)) / max(1, len(pairs)),
        sum(c.isupper() for c in passage) / chars,
        sum(c.isdigit() for c in passage) / chars,
        sum(c in "#*$%&|<>" for c in passage) / n,
        sum(c in "!?" for c in passage) / n,
        sum(c in ".,;:" for c in passage) / n,
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(not c.isalnum() and not c.isspace() for c in passage) / chars,
    )
    index, weight = char_ngrams(passage, (2,), HASHED)
    x[N_SHAPE + index] = weight
    return x


@dataclass(frozen=True)
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray  # tanh branch of the attention
    u: np.ndarray  # gate of the attention
    a: np.ndarray  # attention logits from the gated branches
    w: np.ndarray  # scorer of the weighted passage representation, intercept last

    def attention(self, x: np.ndarray) -> np.ndarray:
        logits = (np.tanh(x @ self.v) * (1 / (1 + np.exp(-np.clip(x @ self.u, -30, 30))))) @ self.a
        e = np.exp(logits - logits.max())
        return e / e.sum()

    def score(self, bag: np.ndarray) -> float:
        x = (bag - self.mean) / self.scale
        z = self.attention(x) @ x
        return float(1 / (1 + np.exp(-np.clip(z @ self.w[:-1] + self.w[-1], -30, 30))))


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, rate: float = 0.02, seed: int = 3) -> MilModel:
    """Trains attention and scorer together from document labels (Adagrad on the log loss)."""
    rng = np.random.default_rng(seed)
    stacked = np.concatenate(bags)
    mean, scale = stacked.mean(0), stacked.std(0) + 1e-3
    rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    x_all = (stacked - mean) / scale
    ends = np.cumsum([len(b) for b in bags])
    d = x_all.shape[1]
    p = {"v": rng.normal(0, 0.1, (d, HIDDEN)), "u": rng.normal(0, 0.1, (d, HIDDEN)), "a": rng.normal(0, 0.1, HIDDEN), "w": np.zeros(d + 1)}
    g2 = {k: np.full_like(x, 1e-4) for k, x in p.items()}
    share = np.bincount(labels, minlength=2) / len(labels)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 64)):
            at = np.sort(at)
            where = np.concatenate([np.arange(ends[i] - len(bags[i]), ends[i]) for i in at])
            x, owner = x_all[where], np.searchsorted(at, rows[where])
            t, s = np.tanh(x @ p["v"]), 1 / (1 + np.exp(-np.clip(x @ p["u"], -30, 30)))
            gate = t * s
            logits = gate @ p["a"]
            e = np.exp(logits - logits.max())
            alpha = e / np.bincount(owner, e, len(at))[owner]
            z = np.zeros((len(at), d))
            np.add.at(z, owner, alpha[:, None] * x)
            y = 1 / (1 + np.exp(-np.clip(z @ p["w"][:-1] + p["w"][-1], -30, 30)))
            # Each class weighs the same: half its inverse share.
            err = (y - labels[at]) * (0.5 / np.maximum(share[labels[at]], 1e-9)) / len(at)
            da = (x @ p["w"][:-1]) * err[owner]
            da = alpha * (da - np.bincount(owner, alpha * da, len(at))[owner])
            dg = da[:, None] * p["a"]
            grads = {
                "v": x.T @ (dg * s * (1 - t**2)), "u": x.T @ (dg * t * s * (1 - s)), "a": gate.T @ da,
                "w": np.append(z.T @ err, err.sum()) + 1e-4 * p["w"],
            }
            for k, grad in grads.items():
                g2[k] += grad**2
                p[k] -= rate * grad / np.sqrt(g2[k])
    return MilModel(mean, scale, p["v"], p["u"], p["a"], p["w"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.concatenate([encode(p) for p in passages(value.as_py())]).astype("<f4").tobytes() for value in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["y", "k", "x"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_per_class: int = SAMPLE_PER_CLASS) -> MilModel | None:
    """Fits the model on every passage of at most ``sample_per_class`` labelled documents a class; documents of more than
    ``MAX_PASSAGES`` passages are no part of the sample. Both bound the training sample only. None without both classes.

    The sample takes each class's smallest id hashes; documents with crc32(id) mod 5 = 0 are never seen.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = {r.y: min(1.0, 1.5 * sample_per_class / r["count"]) for r in marks.groupBy("y").count().collect()}
    if len(share) < 2:
        return None
    key = F.xxhash64(F.lit("mil"), F.col(id_col))
    bound = F.when(F.col("y") == 1, F.lit(int(share[1] * 1e6))).otherwise(F.lit(int(share[0] * 1e6)))
    marks = marks.where(F.pmod(key, F.lit(1_000_000)) < bound)
    short = F.length(text_col) <= MAX_PASSAGES * PASSAGE_CHARS
    texts = docs.where(F.col(text_col).isNotNull() & short).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    marks = marks.select(F.col(id_col).alias("_id"), F.col("y").cast("int").alias("y"), key.alias("k"))
    rows = texts.join(F.broadcast(marks), "_id").select("y", "k", "text")
    sample = sorted((r.y, r.k, bytes(r.x)) for r in rows.mapInArrow(_bags, "y int, k long, x binary").collect())
    kept = [s for y in (0, 1) for s in [s for s in sample if s[0] == y][:sample_per_class]]
    if len({s[0] for s in kept}) < 2:
        return None
    return fit([np.frombuffer(s[2], "<f4").reshape(-1, WIDTH).astype(float) for s in kept], np.array([s[0] for s in kept]))


def score(docs: DataFrame, model: MilModel | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` of every whole text.

    Null and empty texts are one empty passage; without a model every score is 0.5. Rows are scored one
    by one, so repeated rows, null ids and extra columns need no care.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [0.5 if model is None else model.score(np.stack([encode(p) for p in passages(v.as_py())])) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    scored = base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
