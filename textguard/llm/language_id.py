"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from textguard.llm.ngrams import char_ngrams

SIZES = (1, 2, 3)
WIDTH = 4096
CODE_BITS = 15
SAMPLE_PER_LANGUAGE = 1500
MAX_SAMPLE = 12_000
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
# A text is refused when its loss is above both: several times what held-out texts of its length show, and the floor.
REFUSE_TIMES, REFUSE_FLOOR, REFUSE_QUANTILE, REFUSE_EVIDENCE = 4.0, 0.25, 0.99, 20


@dataclass(frozen=True)
class CodeModel:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # bits x (WIDTH + 1), the last one is the intercept
    trust: np.ndarray  # weight of every bit, from its training error
    limits: tuple[tuple[int, float], ...] = ()  # (length band, largest loss of a recognised text)


def fold(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))


def codewords(n: int, bits: int, seed: int = 7) -> np.ndarray:
    """Codewords far apart: of many random codes the one with the largest smallest distance."""
    rng = np.random.default_rng(seed)
    bits = max(bits, int(np.ceil(4 * np.log2(max(2, n)))))
    best, best_distance = None, (-1, -1)
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, -1, 1)[:, None]
        d = (bits - code @ code.T) // 2 + np.eye(n, dtype=int) * bits
        distance = (int(d.min()), int(d.sum()))
        if distance > best_distance:
            best, best_distance = code, distance
    return best


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(2):
            index, weight = char_ngrams(value.as_py(), SIZES, WIDTH)
            rows.append(index.astype("<u4").tobytes() + weight.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["lang", "k", "x"])


def _dense(rows: list[bytes]) -> np.ndarray:
    x = np.zeros((len(rows), WIDTH + 1), np.float32)
    for row, packed in zip(x, rows):
        half = len(packed) // 2
        row[np.frombuffer(packed[:half], "<u4")] = np.frombuffer(packed[half:], "<f4")
        row[-1] = 1
    return x


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE, bits: int = CODE_BITS, epochs: int = 30) -> CodeModel:
    """Fits one logistic classifier per code bit on at most ``sample_per_language`` texts of a language and
    about ``MAX_SAMPLE`` texts in all.

    The sample (the documented bound on what reaches the driver) takes the smallest hashes of a
    language's ids. Every language of the labelled rows gets a codeword.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, 4) != 2))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("lid"), F.col(id_col)).alias("k"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # Many languages share the bound of the whole sample.
    n = counts.count()
    sample_per_language = max(1, min(sample_per_language, MAX_SAMPLE // max(1, n)))
    # A share of each language's rows, taken by hash, keeps the top-n per language small.
    size = counts.select("lang", (F.lit(3.0 * sample_per_language) / F.col("n")).alias("share"))
    picked = rows.join(F.broadcast(size) if n <= BROADCAST_LANGUAGES else size, "lang").where(F.pmod("k", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    picked = picked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("k"))).where(F.col("r") <= sample_per_language)
    # Whole texts become features on the executors: at most WIDTH numbers per sampled text come here.
    features = picked.select("lang", "k", "text").mapInArrow(_features, "lang string, k long, x binary")
    sample = sorted((r.lang, r.k, bytes(r.x)) for r in features.collect())
    languages = tuple(sorted({s[0] for s in sample}))
    if not languages:
        return CodeModel((), np.zeros((0, bits)), np.zeros((bits, WIDTH + 1), np.float32), np.ones(bits))
    codes = codewords(len(languages), bits)
    of = np.array([languages.index(s[0]) for s in sample])
    y = (codes[of] > 0).astype(np.float32)
    balance = (len(sample) / (len(languages) * np.bincount(of, minlength=len(languages))))[of].astype(np.float32)
    # The sample stays sparse; only a batch of it is dense at a time.
    w, g2 = np.zeros((WIDTH + 1, codes.shape[1]), np.float32), np.full((WIDTH + 1, codes.shape[1]), 1e-6, np.float32)
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(sample)), max(1, len(sample) // 128)):
            x = _dense([sample[i][2] for i in at])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ ((p - y[at]) * balance[at, None]) / len(at) + 1e-6 * w
            g2 += grad**2
            w -= 0.5 * grad / np.sqrt(g2)
    side = np.concatenate([_dense([s[2] for s in sample[i : i + 1024]]) @ w > 0 for i in range(0, len(sample), 1024)])
    error = np.clip((side != (y > 0)).mean(0), 0.001, 0.499)
    return CodeModel(languages, codes, w.T.copy(), np.log((1 - error) / error))


def losses(model: CodeModel, margins: np.ndarray) -> np.ndarray:
    """Weighted logistic loss to every codeword."""
    return (np.logaddexp(0, -margins[:, None, :] * model.codes[None]) * model.trust).sum(-1) / model.trust.sum()


def margins_of(model: CodeModel, text: str) -> np.ndarray:
    index, weight = char_ngrams(text, SIZES, WIDTH)
    return model.weights[:, index] @ weight + model.weights[:, -1]


def with_limits(docs: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CodeModel:
    """The model with the loss up to which a text counts as recognised, by length.

    All labelled texts that training has held out and that are decoded to their label are scored. Lengths
    fall into bands of powers of two; a band also sees the texts of the two bands on either side. A band of
    too few texts has no limit.
    """
    if not model.languages:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, found = [], []
            for value, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not _LETTER.search(value):
                    continue
                loss = losses(model, margins_of(model, value)[None])[0]
                if model.languages[int(loss.argmin())] == lang:
                    bands.append(len(value).bit_length())
                    found.append(float(loss.min()))
            yield pa.RecordBatch.from_arrays([pa.array(bands, pa.int32()), pa.array(found, pa.float64())], names=["band", "loss"])

    held = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, 4) == 2))
    scored = held.select(F.col(text_col), F.col(lang_col)).mapInArrow(run, "band int, loss double")
    near = scored.select(F.explode(F.sequence(F.col("band") - 2, F.col("band") + 2)).alias("band"), "loss")
    rows = near.groupBy("band").agg(F.count("*").alias("n"), F.percentile_approx("loss", REFUSE_QUANTILE).alias("loss"))
    # One row per power of two.
    limits = sorted((r.band, max(REFUSE_FLOOR, REFUSE_TIMES * r.loss)) for r in rows.where(F.col("n") >= REFUSE_EVIDENCE).collect())
    return replace(model, limits=tuple(limits))


def decode(model: CodeModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, margin to the second) by the smallest weighted logistic loss to a codeword."""
    loss = losses(model, margins)
    z = np.exp(-(loss - loss.min(1, keepdims=True)) * model.codes.shape[1])
    p = z / z.sum(1, keepdims=True)
    order = np.sort(p, 1)
    return p.argmax(1), p.max(1), order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def identify(docs: DataFrame, model: CodeModel, text_col: str = "text", ambiguous_below: float = 0.2) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score`` and ``ambiguous`` added, from whole texts.

    Null texts, texts without a letter and any text under a model of no language are ``und`` with score
    0, and not ambiguous. So are texts whose loss is above the limit of their length, if the model has
    limits. Equal losses take the first language by name. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    fields = docs.columns
    at = fields.index(text_col)
    limits = dict(model.limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.zeros((batch.num_rows, model.weights.shape[0]), np.float32)
            known = np.zeros(batch.num_rows, bool)
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                if text and model.languages and _LETTER.search(text):
                    margins[i] = margins_of(model, text)
                    limit = limits.get(len(text).bit_length())
                    known[i] = limit is None or losses(model, margins[i : i + 1]).min() <= limit
            if model.languages:
                best, score, margin = decode(model, margins)
                lang = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            else:
                lang, score, margin = [UNKNOWN] * len(known), np.zeros(len(known)), np.ones(len(known))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0).astype(np.float64)), pa.array(known & (margin < ambiguous_below))],
                names=[*fields, "lang_pred", "score", "ambiguous"],
            )

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])
    return docs.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return identify(rows, train(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
