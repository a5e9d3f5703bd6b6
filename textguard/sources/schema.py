"""Column detection and label normalisation for sources of unknown shape.

Detection is one aggregation per source; only its single row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textguard.errors import ColumnNotFoundError, InvalidBinaryLabelError

# Names tried for the text column, in this order. The last two are the names two
# public corpora use on their raw files.
TEXT_CANDIDATES = (
    "tweet_text", "text", "response", "Text", "Summary", "Title", "Main_Narrative", "content", "message",
    "comment_text", "tweet",
)
SARCASM_TEXT_CANDIDATES = ("response", "tweet_text", "text", "tweet")
AUDIT_TEXT_CANDIDATES = ("text", "response", "tweet_text", "comment_text")
LAST_RESORT_TEXT = "Direct_Post_1"
NOT_ABUSIVE = "not_cyberbullying"


def _norm(column: str) -> Column:
    return F.lower(F.trim(F.col(column).cast("string")))


def text_profile(df: DataFrame, candidates: Sequence[str] = TEXT_CANDIDATES) -> DataFrame:
    """Long profile (column, usable): does the column hold any value longer than 3 characters?"""
    present = [c for c in (*candidates, LAST_RESORT_TEXT) if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "column string, usable boolean")
    checks = [
        F.col(c).isNotNull() if c == LAST_RESORT_TEXT else F.length(F.col(c).cast("string")) > 3 for c in present
    ]
    row = df.agg(*[F.coalesce(F.max(x), F.lit(False)).alias(c) for c, x in zip(present, checks)])
    return row.unpivot([], present, "column", "usable")


def detect_text_column(
    df: DataFrame, name: str | None = None, candidates: Sequence[str] = TEXT_CANDIDATES, source: str = "source"
) -> str:
    """The explicit name, or the first usable candidate."""
    if name is not None:
        if name not in df.columns:
            raise ColumnNotFoundError(f"column {name} not in {source}")
        return name
    usable = {r["column"] for r in text_profile(df, candidates).collect() if r["usable"]}
    for candidate in (*candidates, LAST_RESORT_TEXT):
        if candidate in usable:
            return candidate
    raise ColumnNotFoundError(f"no text column in {source}")


def audit_text_column(df: DataFrame) -> str:
    """Text column for the duplicate audit: first known name, else the first column."""
    return next((c for c in AUDIT_TEXT_CANDIDATES if c in df.columns), df.columns[0])


def label_profile(df: DataFrame) -> DataFrame:
    """One row: are all ``type`` values 0/1, and which kinds of value does ``label`` hold?"""
    has_type, has_label = "type" in df.columns, "label" in df.columns
    as_int = F.expr("try_cast(`type` AS double)").cast("int") if has_type else F.lit(None)
    type_ok = F.col("type").isNull() | F.coalesce(as_int.isin(0, 1), F.lit(False)) if has_type else F.lit(False)
    value = _norm("label") if has_label else F.lit(None)

    def any_of(*values: str) -> Column:
        return F.coalesce(F.max(value.isin(*values)), F.lit(False))

    return df.agg(
        F.coalesce(F.min(type_ok), F.lit(has_type)).alias("type_binary"),
        any_of(NOT_ABUSIVE, "0").alias("label_named"),
        any_of("not_sarcasm", "sarcasm").alias("label_sarcasm"),
    )


def detect_label_column(
    df: DataFrame, name: str | None = None, negative: str | None = None, source: str = "source"
) -> tuple[str, tuple[str, ...]]:
    """(column, values that mean class 0); no values means the column is numeric already.

    A ``label`` column holding 0 next to the named class treats both as negative.
    """
    if name is not None:
        if name not in df.columns:
            raise ColumnNotFoundError(f"column {name} not in {source}")
        return name, (negative,) if negative is not None else ()
    if "oh_label" in df.columns:
        return "oh_label", ()
    if "cyberbullying_type" in df.columns:
        return "cyberbullying_type", (NOT_ABUSIVE,)
    if "type" in df.columns or "label" in df.columns:
        seen = label_profile(df).first()
        if seen["type_binary"]:
            return "type", ()
        if "label" in df.columns:
            if seen["label_named"]:
                return "label", (NOT_ABUSIVE, "0")
            return "label", ("not_sarcasm",) if seen["label_sarcasm"] else ()
    raise ColumnNotFoundError(f"no label column in {source}")


def to_binary(column: str, negatives: Sequence[str] = ()) -> Column:
    """0 for the negative values, 1 otherwise; without negative values an integer cast."""
    if negatives:
        return F.when(_norm(column).isin(*[str(n).strip().lower() for n in negatives]), 0).otherwise(1)
    return F.expr(f"try_cast(`{column}` AS double)").cast("int")


def to_binary_auto(df: DataFrame, column: str) -> Column:
    """Cast if every value is 0 or 1, else inequality with the named class; decided inside the plan."""
    value = _norm(column)
    all_binary = df.agg(F.min(F.coalesce(value.isin("0", "1"), F.lit(False)))).scalar()
    named = F.when(value.eqNullSafe(F.lit(NOT_ABUSIVE)), 0).otherwise(1)
    return F.when(all_binary, F.expr(f"try_cast(trim(`{column}`) AS int)")).otherwise(named)


def to_binary_not(column: str, negative: object = 0) -> Column:
    """Inequality with a literal; null counts as different."""
    if isinstance(negative, str):
        return F.when(F.col(column).eqNullSafe(F.lit(negative)), 0).otherwise(1)
    number = F.expr(f"try_cast(`{column}` AS double)")
    return F.when(number.eqNullSafe(F.lit(float(negative))), 0).otherwise(1)


def sarcasm_rule(column: str = "label") -> Column:
    return (F.upper(F.trim(F.col(column).cast("string"))) == "SARCASM").cast("int")


def majority(values: Column | str) -> Column:
    """Most frequent element; among equals the one seen first. Null for an empty array."""
    arr = F.col(values) if isinstance(values, str) else values
    counted = F.transform(
        F.array_distinct(arr),
        lambda v, i: F.struct(F.size(F.filter(arr, lambda w: w == v)).alias("n"), (-i).alias("p"), v.alias("v")),
    )
    return F.array_max(counted)["v"]


def majority_label(values: Column | str, negative: int = 2) -> Column:
    """0 if the majority is ``negative`` or nobody voted, else 1."""
    best = majority(values)
    return F.when(best.isNull() | (best == negative), 0).otherwise(1)


def majority_by_group(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Grouped form for long data: counts combine before the shuffle, so a hot key stays small."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias("majority"))


def assert_binary(df: DataFrame, label: str = "type", source: str = "source") -> DataFrame:
    """Raise unless every label is 0 or 1."""
    bad = df.agg(F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("n")).first()["n"]
    if bad:
        raise InvalidBinaryLabelError(f"{bad} labels of {source} are not 0/1")
    return df


def column_profile(df: DataFrame, max_values: int = 10) -> DataFrame:
    """(column, position, is_text, mean_chars, few_values) for sources without known names.

    Distinct values are counted exactly only for columns whose sketch says there are few.
    """
    columns = df.columns
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    first = df.agg(
        *[F.avg(F.length(c)).alias(f"len_{i}") for i, c in enumerate(columns) if c in text],
        *[F.approx_count_distinct(c).alias(f"acd_{i}") for i, c in enumerate(columns)],
    ).first()
    few = [i for i in range(len(columns)) if first[f"acd_{i}"] <= 4 * max_values]
    exact = df.agg(*[F.count_distinct(columns[i]).alias(f"n_{i}") for i in few]).first() if few else None
    rows = [
        (c, i, c in text, first[f"len_{i}"] if c in text else None, bool(i in few and exact[f"n_{i}"] <= max_values))
        for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, position int, is_text boolean, mean_chars double, few_values boolean"
    )


def guess_columns(df: DataFrame, min_mean: float = 20.0, max_values: int = 10) -> tuple[str, str] | None:
    """(text, label): first string column longer than ``min_mean`` on average, first other with few values."""
    profile = sorted(column_profile(df, max_values).collect(), key=lambda r: r["position"])
    text = next((r["column"] for r in profile if r["is_text"] and (r["mean_chars"] or 0) > min_mean), None)
    label = next((r["column"] for r in profile if r["column"] != text and r["few_values"]), None)
    return (text, label) if text and label else None
