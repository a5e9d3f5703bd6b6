"""Hash-derived ordering: reproducible sampling and splitting without ``rand()``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(id_col: Column | str, seed: int = 42) -> Column:
    """md5 of ``seed:id``; ascending order of this key is the pseudo-random order of rows."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def text_digest(c: Column | str) -> Column:
    """32-byte stand-in for a text, so that grouping by text does not shuffle the text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unhex(F.sha2(c, 256))
