"""Evaluation of predictions: every measure is one aggregation over conditional sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def _rounded(df: DataFrame, columns: Sequence[str], digits: int | None) -> DataFrame:
    return df if digits is None else df.withColumns({c: F.round(c, digits) for c in columns})


def _sum_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def confusion_counts(
    df: DataFrame, label: str = "type", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """tn, fp, fn, tp and n per group, in one pass."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        _sum_if((y == 0) & (p == 0)).alias("tn"),
        _sum_if((y == 0) & (p == 1)).alias("fp"),
        _sum_if((y == 1) & (p == 0)).alias("fn"),
        _sum_if((y == 1) & (p == 1)).alias("tp"),
    )


def _stack(df: DataFrame, by: Sequence[str], names: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """One output row per entry of ``rows``; each entry gives the values for ``names``."""
    structs = [F.struct(*[v.alias(n) for n, v in zip(names, row)]) for row in rows]
    return df.select(*by, F.inline(F.array(*structs)))


def class_distribution(df: DataFrame, label: str = "type") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def confusion_matrix(df: DataFrame, label: str = "type", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Dense 2 x 2 grid: (actual, predicted, n)."""
    counts = confusion_counts(df, label, pred, by)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return _stack(
        counts, by, ("actual", "predicted", "n"), [(F.lit(a), F.lit(p), F.col(c)) for a, p, c in cells]
    )


def binary_metrics(
    df: DataFrame, label: str = "type", pred: str = "pred", by: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """n, accuracy and precision/recall/f1 of class 1; undefined ratios are 0."""
    c = confusion_counts(df, label, pred, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.select(
        *by,
        "n",
        _ratio(tp + tn, F.col("n")).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    return _rounded(out, ["accuracy", "precision", "recall", "f1"], digits)


def classification_report(
    df: DataFrame, label: str = "type", pred: str = "pred", by: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """Long report: rows 0, 1, accuracy, macro avg, weighted avg.

    The accuracy row repeats the accuracy in every column, which is how report files are read back.
    """
    c = confusion_counts(df, label, pred, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    one = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn))
    zero = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fp + fn))
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    n = s0 + s1
    accuracy = _ratio(tp + tn, n)
    macro = tuple((a + b) / 2 for a, b in zip(zero, one))
    weighted = tuple(_ratio(a * s0 + b * s1, n) for a, b in zip(zero, one))
    rows = [
        (F.lit("0"), *zero, s0),
        (F.lit("1"), *one, s1),
        (F.lit("accuracy"), accuracy, accuracy, accuracy, accuracy),
        (F.lit("macro avg"), *macro, n),
        (F.lit("weighted avg"), *weighted, n),
    ]
    out = _stack(c, by, ("row", "precision", "recall", "f1", "support"), rows)
    return _rounded(out, ["precision", "recall", "f1", "support"], digits)


def correctness_distribution(df: DataFrame, label: str = "type", pred: str = "pred") -> DataFrame:
    return df.groupBy(label, (F.col(label) == F.col(pred)).alias("correct")).agg(F.count("*").alias("n"))


def cv_summary(scores: DataFrame, score: str = "f1", by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, population deviation, min and max of the fold scores, best mean first."""
    return (
        scores.groupBy(*by)
        .agg(
            F.avg(score).alias(f"{score}_mean"),
            F.stddev_pop(score).alias(f"{score}_std"),
            F.min(score).alias(f"{score}_min"),
            F.max(score).alias(f"{score}_max"),
        )
        .orderBy(F.desc(f"{score}_mean"), *by)
    )


def _pairwise(df: DataFrame, columns: Sequence[str], cell, name: str) -> DataFrame:
    """All ordered pairs of ``columns`` from one aggregation over the upper triangle."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    agg = df.agg(F.count("*").alias("n"), *[cell(columns[i], columns[j]).alias(f"p{i}_{j}") for i, j in pairs])
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            value = F.lit(1.0) if i == j else F.col(f"p{min(i, j)}_{max(i, j)}")
            rows.append((F.lit(a), F.lit(b), value))
    return _stack(agg, (), ("model_a", "model_b", name), rows)


def agreement_matrix(df: DataFrame, predictions: Sequence[str]) -> DataFrame:
    """Share of rows on which two prediction columns are equal, for every ordered pair."""
    return _pairwise(df, predictions, lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double")), "agreement")


def prediction_correlation(df: DataFrame, predictions: Sequence[str]) -> DataFrame:
    """Pearson correlation for every ordered pair (1 on the diagonal)."""
    return _pairwise(df, predictions, lambda a, b: F.corr(F.col(a).cast("double"), F.col(b).cast("double")), "correlation")


def compare_predictions(
    df: DataFrame, predictions: Sequence[str], label: str = "type", digits: int | None = None
) -> DataFrame:
    """One quality row per prediction column, sorted by F1; the columns are unpivoted in one pass."""
    long = df.select(label, *predictions).unpivot([label], list(predictions), "model", "pred")
    out = binary_metrics(long, label, "pred", by=["model"], digits=digits)
    return out.orderBy(F.desc("f1"), "model")
