"""Strikes beside cells as a join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo
from pluvio.functions.const import STRIKE_KM
from pluvio.operators.spatial import placed, spread

WINDOW_MIN = 15


def strikes_by_cell(cells: DataFrame, strikes: DataFrame, km: float = STRIKE_KM, minutes: int = WINDOW_MIN, late: str = "10 minutes") -> DataFrame:
    """``cell_id, seen_at, strike_id, struck_at, km``: each strike (``strike_id, struck_at, lat, lon``) within ``km`` of a cell (``cell_id, seen_at, lat, lon``) in the ``minutes`` before the cell was seen.

    Both sides may be streams. They meet by cells of a grid that no ``km`` bridges, and by time; a
    watermark of ``late`` on each bounds what is held: a strike as long as a cell of the next
    quarter of an hour may come, a cell until no strike before it may. Rows more than ``late``
    behind their stream's newest may be dropped, so that a batch of the same rows has no more than a
    stream whose rows come within it.
    """
    left = spread(cells.select("cell_id", "seen_at", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")).withWatermark("seen_at", late), km, ("c_lat", "c_lon"))
    right = placed(strikes.select("strike_id", "struck_at", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).withWatermark("struck_at", late), km, ("s_lat", "s_lon"))
    right = right.withColumnsRenamed({"__y": "__sy", "__x": "__sx"})
    near = (F.col("__y") == F.col("__sy")) & (F.col("__x") == F.col("__sx"))
    when = (F.col("struck_at") <= F.col("seen_at")) & (F.col("struck_at") >= F.col("seen_at") - F.expr(f"interval {minutes} minutes"))
    found = left.join(right, near & when).withColumn("km", geo.haversine("c_lat", "c_lon", "s_lat", "s_lon")).where(F.col("km") <= km)
    return found.select("cell_id", "seen_at", "strike_id", "struck_at", "km")
