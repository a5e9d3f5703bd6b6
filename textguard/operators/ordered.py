"""Running values along an order as a prefix scan over range partitions.

A window partitioned by key alone puts a hot key (or, without a key, everything) into one task. Here rows
are dealt by ranges of (keys, order, tie), so a busy moment or a hot key is cut like anything else. Running
values are computed inside a range, the totals of a key's ranges are carried forward, and the two are combined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.session import expanding_partitions, write_through

PART = "_part"


@dataclass(frozen=True)
class Running:
    """``how`` is max, sum or last (the latest non-null value), up to each row or, not ``inclusive``, before it."""

    value: Column
    how: str
    inclusive: bool = True


def seconds(column: str) -> Column:
    """Seconds since the epoch of a timestamp column (with or without time zone)."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


def by_ranges(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """The rows dealt by ranges of (keys, order), written once, with the number of their range in ``_part``.

    The last column of ``order`` should break ties: rows that are equal in all of them stay in one range.
    """
    n = partitions or expanding_partitions(df.sparkSession)
    return write_through(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()))


def scan(ranged: DataFrame, values: Mapping[str, Running], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add the running values to a frame from :func:`by_ranges` (``_part`` stays, so further scans can follow)."""
    keys, order = list(keys), list(order)
    aggs = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    for v in values.values():
        if v.how not in aggs:
            raise ValueError(f"unknown running value {v.how}")
    place = F.struct(*[F.col(c) for c in order])
    held = ranged.select("*", *[v.value.alias(f"_v{i}") for i, v in enumerate(values.values())])

    def total(i: int, v: Running) -> Column:
        if v.how == "last":
            return F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), place)).alias(f"_t{i}")
        return aggs[v.how](f"_v{i}").alias(f"_t{i}")

    totals = held.groupBy(*keys, PART).agg(*[total(i, v) for i, v in enumerate(values.values())])
    # a key has a row for each of its ranges at most
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    on = [*keys, PART]
    carried = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], *[aggs[v.how](f"_t{i}").over(before).alias(f"_c{i}") for i, v in enumerate(values.values())]
    )
    inside = W.partitionBy(*on).orderBy(*order)
    local = held.select(
        "*",
        *[
            aggs[v.how](f"_v{i}").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow if v.inclusive else -1)).alias(f"_l{i}")
            for i, v in enumerate(values.values())
        ],
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(on)])
    out = local.join(carried, same)
    zero = F.lit(0)
    merged = {
        "max": lambda i: F.greatest(f"_l{i}", f"_c{i}"),
        "last": lambda i: F.coalesce(f"_l{i}", f"_c{i}"),
        "sum": lambda i: F.coalesce(f"_l{i}", zero) + F.coalesce(f"_c{i}", zero),
    }
    return out.select(*ranged.columns, *[merged[v.how](i).alias(name) for i, (name, v) in enumerate(values.items())])


def running(df: DataFrame, values: Mapping[str, Running], order: Sequence[str], keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """The rows with all running values added in one scan."""
    return scan(by_ranges(df, order, keys, partitions), values, order, keys).drop(PART)
