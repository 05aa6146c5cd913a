"""Every query by name, and the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pluvio.plans import alert_queries, decision_queries, detail_queries, geo_queries, grid_queries, mass_queries, motion_queries, source_queries, stream_queries  # noqa: F401  they register themselves
from pluvio.plans.fixtures import Scene
from pluvio.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Scene(spark, sf_dir)) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
