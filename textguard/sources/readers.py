"""Reading labelled sources, feature tables, word vectors and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators.quality import merge_datasets, min_length
from textguard.operators.reports import recap_reports
from textguard.operators.sampling import sample_n
from textguard.sources import schema as S

# Cells a table reader takes for missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
_SOURCE_BITS = 53  # row ids of one source stay below 2**53, so up to 1,024 sources share one id space


def read_raw(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV (all columns as strings, missing markers as null) or parquet, by suffix.

    Quoted line breaks are legal CSV but make a file unsplittable; pass ``multiline=False`` for
    very large files known to have none.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("xlsx", "xls"):
        raise ValueError("spreadsheets are not read; convert them to CSV or parquet")
    raw = spark.read.csv(path, header=True, multiLine=multiline, escape='"')
    return raw.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def _finish(df: DataFrame, n_samples: int | None, source: str, ordinal: int) -> DataFrame:
    row = F.col("_row") if "_row" in df.columns else F.monotonically_increasing_id()
    out = df.withColumn("doc_id", row + F.lit(ordinal << _SOURCE_BITS))
    if n_samples is not None:
        out = sample_n(out, n_samples)
    return out.select("doc_id", F.col("text").cast("string").alias("text"), "type", F.lit(source).alias("source"))


def normalise_labelled(
    raw: DataFrame,
    text_col: str | None = None,
    label_col: str | None = None,
    negative_class: str | None = None,
    n_samples: int | None = None,
    source: str = "source",
    ordinal: int = 0,
    id_col: str | None = None,
) -> DataFrame:
    """Any labelled frame -> (doc_id, text, type, source) with 0/1 labels, nulls dropped.

    Without ``id_col`` rows are numbered by their place in the scan; that is stable for files, but
    a frame that comes out of a shuffle must bring an id column of its own (unique, below 2**53).
    """
    text = S.detect_text_column(raw, text_col, source=source)
    label, negatives = S.detect_label_column(raw, label_col, negative_class, source)
    ids = [F.col(id_col).cast("long").alias("_row")] if id_col else []
    df = raw.select(*ids, F.col(text).alias("text"), F.col(label).alias("_label")).dropna(subset=["text", "_label"])
    df = df.withColumn("type", S.to_binary("_label", negatives)).drop("_label")
    return S.assert_binary(_finish(df, n_samples, source, ordinal), source=source)


def read_labelled(spark: SparkSession, path: str, **options) -> DataFrame:
    """One labelled file, see :func:`normalise_labelled` for the options."""
    options.setdefault("source", path.rstrip("/").rsplit("/", 1)[-1])
    return normalise_labelled(read_raw(spark, path), **options)


def read_sarcasm(
    spark: SparkSession,
    path: str,
    text_col: str | None = None,
    label_col: str | None = None,
    n_samples: int | None = None,
) -> DataFrame:
    """Sarcasm corpora: 1 iff the label says so, texts of at least 5 characters."""
    raw = read_raw(spark, path)
    text = S.detect_text_column(raw, text_col, S.SARCASM_TEXT_CANDIDATES, source=path)
    label = label_col or ("label" if "label" in raw.columns else "type")
    if label not in raw.columns:
        raise S.ColumnNotFoundError(f"column {label} not in {path}")
    df = raw.select(F.col(text).alias("text"), F.col(label).alias("_label")).dropna()
    df = min_length(df.withColumn("type", S.sarcasm_rule("_label")).drop("_label"))
    return _finish(df, n_samples, path.rstrip("/").rsplit("/", 1)[-1], 0)


def read_many(
    spark: SparkSession, paths: Sequence[str], n_samples: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(corpus, errors): every readable source, at most ``n_samples`` rows of each, in one lazy union.

    A source that is missing or has no usable columns is recorded in ``errors`` (source, error).
    """
    frames, errors = [], []
    for ordinal, path in enumerate(paths):
        try:
            frames.append(read_labelled(spark, path, n_samples=n_samples, ordinal=ordinal))
        except (AnalysisException, ValueError) as error:
            errors.append((path, f"{type(error).__name__}: {error}"[:500]))
    failed = spark.createDataFrame(errors, "source string, error string")
    if not frames:
        raise ValueError(f"no usable source among {len(paths)}")
    return merge_datasets(frames), failed


def read_processed(spark: SparkSession, root: str, embedding: str) -> DataFrame | None:
    """Feature table of one embedding (partition pruned), or ``None`` if it was never written."""
    try:
        table = spark.read.parquet(root)
    except AnalysisException:
        return None
    rows = table.where(F.col("embedding") == embedding)
    return None if rows.isEmpty() else rows


def feature_columns(df: DataFrame, embedding: str, column: str = "text") -> list[str]:
    """Columns of a wide feature table that belong to ``embedding``, chosen by prefix."""
    return [c for c in df.columns if c.startswith(f"{column}_{embedding}")]


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word v1 .. vn`` per line -> (word, vector array<float>)."""
    parts = spark.read.text(path).where("length(trim(value)) > 0").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select(
        F.col("p")[0].alias("word"),
        F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda v: v.cast("float")).alias("vector"),
    )


def read_reports(spark: SparkSession, glob: str, missing: float | None = 0.0) -> DataFrame:
    """Recap over report CSV files, or the folders that ``write_report_csv`` makes; the name of either
    carries model and embedding. A row that does not parse fails the job."""
    path = F.col("_metadata.file_path")
    folder = F.element_at(F.split(path, "/"), -2)
    long = (
        spark.read.option("mode", "FAILFAST")
        .schema("row string, precision double, recall double, f1 double, support double")
        .csv(glob, header=True, enforceSchema=True)
        .select("*", F.when(folder.endswith("_report.csv"), folder).otherwise(F.col("_metadata.file_name")).alias("file_name"))
    )
    return recap_reports(long, missing=missing)
