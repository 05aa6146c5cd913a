"""Holding a query's rows against those of its SQL on DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        if Path(sf_dir, f"{name}.parquet").exists():
            con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A value in a form that both engines share: floats to nine digits, times as text, nested values in tuples."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return float(value)


def rows(table) -> list[tuple]:
    """The rows of an Arrow table, columns by name, in an order of their own."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(map(plain, r)) for r in zip(*columns, strict=True)), key=repr)


def difference(spark_table, duck_table) -> str | None:
    """What differs first, or None."""
    a, b = sorted(spark_table.column_names), sorted(duck_table.column_names)
    if a != b:
        return f"columns {a} against {b}"
    left, right = rows(spark_table), rows(duck_table)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    return next((f"{x} against {y}" for x, y in zip(left, right, strict=True) if x != y), None)
