"""Runs a query and its SQL twin and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    left_columns, left = _rows(df.columns, df.collect())
    right_columns, right = _rows(sql_columns, result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if not wrong:
        return None
    a, b = wrong[0]
    parts = [
        f"{n}: {str(x)[:300]!r} != {str(y)[:300]!r}"
        for n, x, y in zip(left_columns, a, b, strict=True)
        if x != y
    ]
    return f"{len(wrong)} of {len(left)} rows differ, first: " + "; ".join(parts)
