"""Expressions over array<numeric> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(c: Column | str) -> Column:
    return F.transform(_col(c), lambda x: x.cast("double"))


def array_sum(c: Column | str) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once; inside a lambda it would run per element."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column | str) -> Column:
    """Shifted by the maximum, so large logits do not overflow."""
    z = as_doubles(logits)
    exps = let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    return let(exps, lambda e: let(array_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def argmax(values: Column | str) -> Column:
    """0-based place of the first maximum."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def classify_logits(logits: Column | str) -> Column:
    """struct<label, confidence, probs> from the raw scores of a sequence classifier."""
    probs = softmax(logits)
    return F.struct(argmax(logits).alias("label"), F.array_max(probs).alias("confidence"), probs.alias("probs"))


def l2_normalize(values: Column | str) -> Column:
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(norm, lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))

    return let(as_doubles(values), scaled)
