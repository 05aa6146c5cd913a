"""Joins by distance. Points meet in cells of a grid, so that each join is an equi-join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo


def _cells(km: float, top: float) -> tuple[float, float]:
    """Height and width in degrees of cells that no ``km`` bridges, up to the latitude ``top``."""
    return km / 110.57, km / (110.57 * max(0.05, math.cos(math.radians(min(top + 1.0, 87.0)))))


def _held(lat: str, top: float) -> Column:
    beyond = F.raise_error(F.lit(f"a point lies beyond latitude {top:g}; give range_join a higher one")).cast("double")
    return F.when(F.abs(F.col(lat)) > top, beyond).otherwise(F.col(lat))


def placed(rows: DataFrame, km: float, at: tuple[str, str] = ("s_lat", "s_lon"), top: float = 60.0) -> DataFrame:
    """``rows`` with ``__y, __x``, the cell that a point lies in."""
    high, wide = _cells(km, top)
    return rows.withColumn("__y", F.floor(_held(at[0], top) / high)).withColumn("__x", F.floor(F.col(at[1]) / wide))


def spread(rows: DataFrame, km: float, at: tuple[str, str] = ("lat", "lon"), top: float = 60.0) -> DataFrame:
    """``rows`` nine times, in the cell that a point lies in and those around it."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    own = placed(rows, km, at, top).withColumn("__n", near)
    return own.withColumn("__y", F.col("__y") + F.col("__n.a")).withColumn("__x", F.col("__x") + F.col("__n.b")).drop("__n")


def range_join(left: DataFrame, right: DataFrame, km: float, at: tuple[str, str] = ("lat", "lon"), other: tuple[str, str] = ("s_lat", "s_lon"), on: tuple[str, ...] = (), top: float = 60.0) -> DataFrame:
    """Rows of both sides at most ``km`` apart, and equal in ``on``, with the distance as ``km``.

    One width of cells serves all rows, sized for latitude ``top``; a point beyond it raises an
    error. The left rows, which should be the fewer, are copied to the nine cells around them.
    """
    found = spread(left, km, at, top).join(placed(right, km, other, top), ["__y", "__x", *on])
    return found.withColumn("km", geo.haversine(at[0], at[1], other[0], other[1])).where(F.col("km") <= km).drop("__y", "__x")


def links(points: DataFrame, km: float, key: str, on: tuple[str, ...] = (), top: float = 60.0) -> DataFrame:
    """Pairs ``a < b`` of the points' ``key`` at most ``km`` apart, with ``on`` and the distance."""
    one = points.select(*on, F.col(key).alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    two = points.select(*on, F.col(key).alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    return range_join(one, two, km, ("a_lat", "a_lon"), ("b_lat", "b_lon"), on, top).where("a < b").select(*on, "a", "b", "km")
