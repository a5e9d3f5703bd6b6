"""Runs registered queries against their SQL counterpart in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if hasattr(value, "item"):
        return _norm(value.item())
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_norm(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


def differences(spark_df, con, sql: str, limit: int = 5):
    """(spark rows, sql rows, list of differences); column names, types and values must agree."""
    left_cols, left = _table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    right_cols, right = _table(rel.columns, rel.fetchall())
    problems = []
    if left_cols != right_cols:
        problems.append(f"columns {left_cols} != {right_cols}")
    elif len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    else:
        for a, b in zip(left, right):
            if a != b or [type(x) for x in a] != [type(x) for x in b]:
                problems.append(f"{a!r} != {b!r}"[:600])
                if len(problems) >= limit:
                    break
    kinds = {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "float": "FLOAT", "date": "DATE",
    }
    sql_types = dict(zip(rel.columns, map(str, rel.types)))
    for name, dtype in spark_df.dtypes:
        if kinds.get(dtype, dtype) != sql_types.get(name):
            problems.append(f"type of {name}: {dtype} != {sql_types.get(name)}")
    return len(left), len(right), problems
