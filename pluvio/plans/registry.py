"""Queries by name, with the DuckDB SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pluvio.plans.fixtures import Scene

QUERIES: dict[str, Callable[[Scene], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Scene], DataFrame]) -> Callable[[Scene], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
