"""Exact-size sampling, splitting and fold assignment by hash order.

A window over the whole corpus (or over one of two labels) would rank everything in one task.
Here the n-th smallest hash per stratum is found instead: a histogram over the first four hex
digits of the key (at most 65,536 rows per stratum), then a ranking inside the single bucket that
holds the wanted row. Rows are then labelled by comparing their key with that one value, so the
corpus itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.functions.hashing import order_key

_ALL = "_all"


def hash_cuts(
    df: DataFrame,
    id_col: str,
    ranks: Callable[[Column], Column],
    strata: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """One row per stratum with ``cuts``: the keys found at the wanted 1-based ranks, ascending.

    ``ranks`` maps the stratum's row count to an array of ranks. Ranks below 1 yield no cut.
    """
    strata = list(strata)
    keys = df.select(*(strata or [F.lit(0).alias(_ALL)]), order_key(id_col, seed).alias("_key"))
    by = strata or [_ALL]
    keys = keys.withColumn("_bucket", F.substring("_key", 1, 4))
    hist = keys.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    per_stratum = W.partitionBy(*by)
    hist = hist.select(
        *by,
        "_bucket",
        F.sum("_n").over(per_stratum.orderBy("_bucket")).alias("_upto"),
        (F.sum("_n").over(per_stratum.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(per_stratum).alias("_total"),
    )
    hits = hist.select(
        *by,
        "_bucket",
        F.transform(
            F.filter(
                F.transform(ranks(F.col("_total")), lambda r: r.cast("long")),
                lambda r: (r > F.col("_before")) & (r <= F.col("_upto")),
            ),
            lambda r: r - F.col("_before"),
        ).alias("_ranks"),
    ).where(F.size("_ranks") > 0)
    # at most one bucket per stratum and rank; adaptive execution broadcasts it while it is small
    hits = hits.select(*[F.col(c).alias(f"_h_{c}") for c in by], F.col("_bucket").alias("_h_bucket"), "_ranks")
    same = F.col("_bucket") == F.col("_h_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    inside = keys.join(hits, same)
    place = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_key"))
    found = inside.withColumn("_place", place.cast("long")).where(F.array_contains("_ranks", F.col("_place")))
    return found.groupBy(*by).agg(F.array_sort(F.collect_list("_key")).alias("cuts"))


def _with_cuts(df: DataFrame, cuts: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Attach ``cuts`` (one row per stratum) to every row; the rows stay in place while that table is small."""
    if not strata:
        return df.withColumn("cuts", cuts.select("cuts").scalar())
    side = cuts.select(*[F.col(c).alias(f"_c_{c}") for c in strata], "cuts")
    same = None
    for c in strata:
        term = F.col(c).eqNullSafe(F.col(f"_c_{c}"))
        same = term if same is None else same & term
    return df.join(side, same, "left").drop(*[f"_c_{c}" for c in strata])


def sample_n(df: DataFrame, n: int, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, reproducible for a seed."""
    cuts = hash_cuts(df, id_col, lambda total: F.array(F.least(F.lit(n), total)), seed=seed)
    return df.where(order_key(id_col, seed) <= cuts.select(F.element_at("cuts", 1)).scalar())


def train_test_split(
    df: DataFrame,
    test_size: float = 0.2,
    id_col: str = "doc_id",
    seed: int = 42,
    stratify: str | None = None,
    exact: bool = True,
) -> DataFrame:
    """Add ``split`` in {train, test}; the test part has ``ceil(rows * test_size)`` rows.

    ``stratify`` names a label column whose proportions are kept,
    whatever the number of its values. ``exact=False`` thresholds the hash in one pass instead.
    """
    key = order_key(id_col, seed)
    if not exact:
        share = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(16**8)
        return df.withColumn("split", F.when(share < test_size, "test").otherwise("train"))
    strata = [stratify] if stratify else []
    cuts = hash_cuts(
        df, id_col, lambda total: F.array(F.ceil(total * F.lit(float(test_size)))), strata=strata, seed=seed
    )
    marked = _with_cuts(df, cuts, strata)
    return marked.withColumn(
        "split", F.when(key <= F.get("cuts", F.lit(0)), "test").otherwise("train")
    ).drop("cuts")


def assign_folds(
    df: DataFrame, k: int = 5, label_col: str | None = "type", id_col: str = "doc_id", seed: int = 42
) -> DataFrame:
    """Add ``fold`` in 0..k-1; fold sizes within a label differ by at most one row."""
    strata = [label_col] if label_col else []

    def ends(total: Column) -> Column:
        base, extra = F.floor(total / k), total % k
        return F.array(*[F.lit(f) * base + F.least(F.lit(f), extra) for f in range(1, k)])

    marked = _with_cuts(df, hash_cuts(df, id_col, ends, strata=strata, seed=seed), strata)
    key = order_key(id_col, seed)
    # ranks of folds that stay empty (fewer rows than folds) repeat an earlier rank
    fold = F.coalesce(F.size(F.filter("cuts", lambda c: c < key)), F.lit(0))
    return marked.withColumn("fold", fold.cast("int")).drop("cuts")
