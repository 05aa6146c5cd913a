"""Rain on a grid: the strongest hit of each cell, coarser where a frame has too many cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions.classify import level_of_rate
from pluvio.functions.const import CELL_LAT, CELL_LON, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, MAX_CELLS
from pluvio.functions.geo import half_up

FACTORS = (1, 2, 4, 8)


def in_bbox(hits: DataFrame) -> DataFrame:
    """Hits within the radar's box, edges included."""
    return hits.where(F.col("lat").between(LAT_MIN, LAT_MAX) & F.col("lon").between(LON_MIN, LON_MAX))


def aggregate(hits: DataFrame, most: int = MAX_CELLS, frame: str = "frame_time") -> DataFrame:
    """Samples of each frame: ``lat, lon, level, rate, cell_km`` of every cell that is wet.

    Cells of the finest grid keep their strongest hit before anything else, so that what follows is
    bounded by cells, not hits. Coarser grids are not nested in finer ones to the last bit, so each
    is binned from the hits; the four cell counts come from one pass. Each frame takes the first
    factor under which it has at most ``most`` cells, or the last.
    """
    cell = lambda x, low, size, f: F.floor((F.col(x) - low) / (size * f))
    # The cells of a hit come first, as plain numbers: hits of the same ones meet before they are spread over the factors.
    own = {f"{n}{f}": cell(x, low, size, f) for f in FACTORS for n, x, low, size in (("i", "lat", LAT_MIN, CELL_LAT), ("j", "lon", LON_MIN, CELL_LON))}
    fine = hits.select(frame, "rate", *[c.alias(n) for n, c in own.items()]).groupBy(frame, *own).agg(F.max("rate").alias("rate"))
    bins = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"i{f}").alias("i"), F.col(f"j{f}").alias("j")) for f in FACTORS])
    cells = fine.select(frame, "rate", F.inline(bins)).groupBy(frame, "factor", "i", "j").agg(F.max("rate").alias("rate"))
    counts = cells.groupBy(frame, "factor").agg(F.count("*").alias("n"))
    chosen = counts.groupBy(frame).agg(F.coalesce(F.min(F.when(F.col("n") <= most, F.col("factor"))), F.lit(FACTORS[-1])).alias("factor"))
    found = cells.join(chosen, [frame, "factor"])
    lat, lon = LAT_MIN + (F.col("i") + 0.5) * (CELL_LAT * F.col("factor")), LON_MIN + (F.col("j") + 0.5) * (CELL_LON * F.col("factor"))
    out = found.select(frame, half_up(lat, 3).alias("lat"), half_up(lon, 3).alias("lon"), level_of_rate(F.col("rate")).alias("level"), half_up(F.col("rate"), 1).alias("rate"), (F.lit(3.0) * F.col("factor")).alias("cell_km"))
    return out.where("level > 0")
