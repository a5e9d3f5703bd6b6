"""Explanations of predictions: local linear models, Shapley values, readable rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.operators.models import score
from textguard.session import expanding_partitions

KERNEL_WIDTH = 25.0
_SPLIT = re.compile(r"\W+")


# --- local linear explanation of a text ------------------------------------------------------------


def split_for_masking(text: str) -> tuple[list[str], list[str], np.ndarray]:
    """(distinct words, all pieces of the text, word number of each piece or -1 for separators)."""
    pieces = re.split(r"(\W+)", text)
    numbers: dict[str, int] = {}
    places = []
    for i, piece in enumerate(pieces):
        word = i % 2 == 0 and piece != ""
        places.append(numbers.setdefault(piece, len(numbers)) if word else -1)
    return list(numbers), pieces, np.array(places)


def draw_masks(doc_id, n_words: int, samples: int, seed: int) -> np.ndarray:
    """Kept words per sample; the first sample keeps all. A function of seed and document only."""
    rng = np.random.default_rng([seed, zlib.crc32(str(doc_id).encode())])
    masks = np.ones((samples, n_words), dtype=bool)
    for row in range(1, samples):
        drop = rng.choice(n_words, rng.integers(1, n_words + 1), replace=False)
        masks[row, drop] = False
    return masks


def weighted_ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients of a ridge regression with intercept and row weights (dual form if wide)."""
    w = w / w.sum()
    xc, yc = x - w @ x, y - w @ y
    # the penalty is relative to the sum of weights, which was scaled to 1
    xs, ys = xc * np.sqrt(w)[:, None], yc * np.sqrt(w)
    rows, cols = x.shape
    if cols <= rows:
        return np.linalg.solve(xs.T @ xs + alpha * np.eye(cols), xs.T @ ys)
    return xs.T @ np.linalg.solve(xs @ xs.T + alpha * np.eye(rows), ys)


def local_weights(masks: np.ndarray, proba: np.ndarray, num_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen word numbers, weights) of the linear model around the full text."""
    x = masks.astype("float64")
    kept = x.sum(axis=1)
    distance = (1.0 - np.sqrt(kept / x.shape[1])) * 100.0  # cosine distance to the full text
    w = np.sqrt(np.exp(-(distance**2) / KERNEL_WIDTH**2))
    total = w.sum()
    if num_features <= 6 and num_features < x.shape[1]:
        chosen: list[int] = []  # forward selection by weighted fit
        for _ in range(num_features):
            best, best_err = None, np.inf
            for j in range(x.shape[1]):
                if j not in chosen:
                    cols = x[:, [*chosen, j]]
                    beta = weighted_ridge(cols, proba, w, 1e-9 / total)
                    resid = (proba - w @ proba / total) - (cols - w @ cols / total) @ beta
                    err = w @ resid**2
                    if err < best_err:
                        best, best_err = j, err
            chosen.append(best)
        picked = np.array(chosen)
    else:
        rough = weighted_ridge(x, proba, w, 0.01 / total)
        picked = np.argsort(-np.abs(rough), kind="stable")[:num_features]
    beta = weighted_ridge(x[:, picked], proba, w, 1.0 / total)
    order = np.argsort(-np.abs(beta), kind="stable")
    return picked[order], beta[order]


def explain_texts(
    df: DataFrame,
    model: Transformer,
    text_col: str = "text",
    id_col: str = "doc_id",
    num_features: int = 10,
    num_samples: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """(id, pred, confidence, explanation array<struct<word, weight>>) per text.

    Perturbed texts of all documents are scored by one distributed transform; only sample number
    and probability go to the per-document solve, which draws the same masks again. A group is
    ``num_samples`` rows, whatever the text.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def perturb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch[id_col], batch["text"]):
                words, pieces, places = split_for_masking(text)
                count = num_samples if words else 1
                masks = draw_masks(doc, len(words), count, seed)
                for at in range(0, count, 100):
                    chunk = masks[at : at + 100]
                    texts = [
                        "".join(p for p, w in zip(pieces, places) if w < 0 or mask[w]) for mask in chunk
                    ]
                    yield pd.DataFrame({id_col: doc, "_sample": range(at, at + len(chunk)), text_col: texts})

    parts = expanding_partitions(df.sparkSession)
    spread = docs.repartition(parts, id_col)
    samples = spread.mapInPandas(perturb, f"`{id_col}` {id_type}, _sample int, `{text_col}` string")
    scored = score(samples, model).select(id_col, "_sample", "proba")
    grouped = scored.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_sample", "proba"))).alias("_s"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, proba in zip(batch[id_col], batch["text"], batch["_p"]):
                words, _, _ = split_for_masking(text)
                p = np.asarray(proba)
                explanation = []
                if words:
                    picked, beta = local_weights(draw_masks(doc, len(words), len(p), seed), p, num_features)
                    explanation = [{"word": words[i], "weight": float(b)} for i, b in zip(picked, beta)]
                rows.append((doc, int(p[0] > 0.5), float(max(p[0], 1 - p[0])), explanation))
            yield pd.DataFrame(rows, columns=[id_col, "pred", "confidence", "explanation"])

    paired = docs.join(grouped, id_col).select(id_col, "text", F.col("_s.proba").alias("_p"))
    return paired.mapInPandas(
        solve,
        f"`{id_col}` {id_type}, pred int, confidence double, explanation array<struct<word: string, weight: double>>",
    )


# --- Shapley values ----------------------------------------------------------------------------------


def linear_shap(
    df: DataFrame, weights: Sequence[float], vector: str | Column = "features", id_col: str = "doc_id"
) -> DataFrame:
    """Exact values of a linear model: ``w_j (x_j - mean_j)`` as (id, feature, value).

    Means come from one pass; they and the weights (one number per feature) are literals of the plan.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    mean = df.agg(Summarizer.metrics("mean").summary(v).alias("s")).first()["s"]["mean"]
    w = F.lit([float(x) for x in weights])
    centre = F.lit([float(x) for x in mean])
    shifted = F.zip_with(vector_to_array(v), centre, lambda x, m: x - m)
    return df.select(id_col, F.posexplode(F.zip_with(shifted, w, lambda d, c: d * c)).alias("feature", "value"))


def permutation_shap(
    df: DataFrame,
    model: Transformer,
    id_col: str = "doc_id",
    permutations: int = 4,
    background: int = 20,
    seed: int = 42,
    features: str = "features",
) -> DataFrame:
    """(id, feature, value) for any model, from random walks between background rows and the row.

    A walk switches the differing features one by one in random order; the change of the
    probability at each step is that feature's contribution, so the values of a walk add up to
    ``f(x) - f(background row)`` exactly. ``background`` rows (a bounded sample) travel with the
    tasks. All walk points are scored by one transform.
    """
    from textguard.operators.sampling import sample_n

    id_type = df.schema[id_col].dataType.simpleString()
    base = df.select(id_col, vector_to_array(features).alias("x"))
    rows = sample_n(base, background, id_col, seed).select("x").limit(background).collect()
    reference = np.array([r["x"] for r in rows])

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, x in zip(batch[id_col], batch["x"]):
                x = np.asarray(x, dtype="float64")
                rng = np.random.default_rng([seed, zlib.crc32(str(doc).encode())])
                for walk in range(permutations):
                    point = reference[rng.integers(len(reference))].copy()
                    order = rng.permutation(np.flatnonzero(point != x))
                    steps, points = [-1], [point.copy()]
                    for step, j in enumerate(order):
                        point[j] = x[j]
                        steps.append(int(j)), points.append(point.copy())
                        if len(points) == 256:
                            yield pd.DataFrame({id_col: doc, "_walk": walk, "_step": range(step - len(points) + 2, step + 2), "feature": steps, "p": points})
                            steps, points = [], []
                    if points:
                        end = len(order)
                        yield pd.DataFrame({id_col: doc, "_walk": walk, "_step": range(end - len(points) + 1, end + 1), "feature": steps, "p": points})

    schema = f"`{id_col}` {id_type}, _walk int, _step int, feature int, p array<double>"
    points = base.repartition(expanding_partitions(df.sparkSession), id_col).mapInPandas(walks, schema)
    scored = score(points.select(id_col, "_walk", "_step", "feature", array_to_vector("p").alias("features")), model)
    # a walk has at most one point per feature, so its window is bounded
    walk = W.partitionBy(id_col, "_walk").orderBy("_step")
    gain = scored.withColumn("_gain", F.col("proba") - F.lag("proba").over(walk)).where("feature >= 0")
    return gain.groupBy(id_col, "feature").agg((F.sum("_gain") / permutations).alias("value"))


def top_features(
    values: DataFrame, k: int = 10, names: Sequence[str] | None = None, class_index: int | None = None, rows: int | None = None
) -> DataFrame:
    """(feature, mean_abs): features by mean absolute value.

    ``values`` is long (id, feature, value[, class]); absent features count as 0 if the number of
    ``rows`` is given. Without ``names`` features are called ``Feature_i``.
    """
    if class_index is not None and "class" in values.columns:
        values = values.where(F.col("class") == class_index)
    total = F.sum(F.abs("value")) / rows if rows else F.avg(F.abs("value"))
    top = values.groupBy("feature").agg(total.alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(k)
    if names is None:
        label = F.concat(F.lit("Feature_"), F.col("feature").cast("string"))
    else:
        label = F.get(F.lit(list(names)), F.col("feature").cast("int"))
    return top.select(label.alias("feature"), "mean_abs")


# --- readable forms ----------------------------------------------------------------------------------


def explanation_rows(df: DataFrame, id_col: str = "doc_id", explanation: str = "explanation") -> DataFrame:
    """One line per influential word: ``+ word: 0.123`` (a minus unless the weight is positive)."""
    word = df.select(id_col, F.posexplode(explanation).alias("rank", "e")).select(id_col, "rank", "e.word", "e.weight")
    sign = F.when(F.col("weight") > 0, "+").otherwise("-")
    return word.withColumn("line", F.format_string("%s %s: %.3f", sign, F.col("word"), F.col("weight")))


def format_explanation(pred: Column, confidence: Column, explanation: Column) -> Column:
    """Readable multi-line text of a whole explanation."""
    lines = F.transform(
        explanation,
        lambda e: F.format_string("  %s %s: %.3f", F.when(e["weight"] > 0, "+").otherwise("-"), e["word"], e["weight"]),
    )
    head = F.format_string("Prediction: %d\nConfidence: %.2f%%\n\nInfluential words:\n", pred, confidence * 100)
    return F.concat(head, F.array_join(lines, "\n"))
