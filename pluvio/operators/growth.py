"""The same rain in consecutive frames: cells matched one to one along a trail."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions import geo
from pluvio.functions.classify import level_of_rate, rate_of_sample
from pluvio.functions.const import LINK_KM
from pluvio.operators.spatial import range_join
from pluvio.operators.trails import TRACK

PAIRS = "scan_time long, trail_id long, frame_time long, minutes double, i int, j int, km double, change double"
#: Minutes for which a trend is carried on in full, and by which what is beyond fades to 1/e.
APPLY_MIN, FADE_MIN = 18, 30


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """The closest pair first, then the closest of what is left; a frame's trail has at most 9000 cells."""
    rows = rows.sort_values(["km", "i", "j"])
    seen_i, seen_j, keep = set(), set(), np.zeros(len(rows), dtype=bool)
    for n, (i, j) in enumerate(zip(rows["i"].tolist(), rows["j"].tolist(), strict=True)):
        if i not in seen_i and j not in seen_j:
            seen_i.add(i)
            seen_j.add(j)
            keep[n] = True
    return rows[keep]


def matched_cells(trails: DataFrame, members: DataFrame, km: float = LINK_KM) -> DataFrame:
    """``scan_time, trail_id, frame_time, minutes, i, j, km, change``: cell i of a frame is cell j of the trail's frame before, ``minutes`` ago, whose centre has moved on; ``change`` is in mm/h.

    Candidates come from a range join after each trail's earlier cells are moved by the hop of its
    mean point. Each hop of a trail is matched in one task, closest pairs first.
    """
    cells = trails.select(*TRACK, "frame_time", "mass_id").join(members.select("frame_time", "mass_id", "lat", "lon", rate_of_sample(F.col("rate"), F.col("level")).alias("r")), ["frame_time", "mass_id"])
    cells = cells.withColumn("k", F.row_number().over(Window.partitionBy(*TRACK, "frame_time").orderBy("lat", "lon")))
    means = cells.groupBy(*TRACK, "frame_time").agg(F.avg("lat").alias("m_lat"), F.avg("lon").alias("m_lon"))
    order = Window.partitionBy(*TRACK).orderBy("frame_time")
    hops = means.withColumns({"prev": F.lag(F.struct("frame_time", "m_lat", "m_lon")).over(order)}).where("prev is not null")
    hops = hops.select(*TRACK, F.col("frame_time").alias("next_time"), F.col("prev.frame_time").alias("frame_time"), ((F.col("frame_time") - F.col("prev.frame_time")) / 60.0).alias("minutes"), (F.col("m_lat") - F.col("prev.m_lat")).alias("d_lat"), (F.col("m_lon") - F.col("prev.m_lon")).alias("d_lon"))
    moved = cells.join(hops, [*TRACK, "frame_time"]).select(*TRACK, "minutes", F.col("next_time").alias("frame_time"), F.col("k").alias("j"), (F.col("lat") + F.col("d_lat")).alias("s_lat"), (F.col("lon") + F.col("d_lon")).alias("s_lon"), F.col("r").alias("before"))
    now = cells.select(*TRACK, "frame_time", F.col("k").alias("i"), "lat", "lon", "r")
    near = range_join(now, moved, km, on=(*TRACK, "frame_time"))
    pairs = near.select(F.col("scan_time").cast("long"), F.col("trail_id").cast("long"), F.col("frame_time").cast("long"), "minutes", F.col("i").cast("int"), F.col("j").cast("int"), geo.half_up(F.col("km"), 9).alias("km"), (F.col("r") - F.col("before")).alias("change"))
    return pairs.groupBy(*TRACK, "frame_time").applyInPandas(_greedy, PAIRS)


def growth(pairs: DataFrame) -> DataFrame:
    """``scan_time, trail_id, delta, slope`` of matched cells: the sum of all changes in mm/h, and the change of the mean a minute over the hops that have pairs."""
    hops = pairs.groupBy(*TRACK, "frame_time", "minutes").agg(F.sum("change").alias("sum"), F.avg("change").alias("mean"))
    return hops.groupBy(*TRACK).agg(F.sum("sum").alias("delta"), (F.sum("mean") / F.sum("minutes")).alias("slope"))


def increment(slope: Column, t: Column) -> Column:
    """What a trend adds in mm/h after ``t`` minutes."""
    faded = slope * APPLY_MIN * F.exp((APPLY_MIN - t) / float(FADE_MIN))
    return F.when((t <= 0) | (slope == 0), 0.0).when(t <= APPLY_MIN, slope * t).otherwise(faded)


def grown(timeline: DataFrame, slope: Column) -> DataFrame:
    """A timeline (t, level, rate, unknown) with a trend added; dry and unknown steps stay as they are."""
    extra = increment(slope, F.col("t"))
    rate = F.greatest(F.lit(0.0), geo.half_up(F.col("rate") + extra, 1))
    same = F.col("unknown") | (F.col("rate") <= 0) | (extra == 0)
    return timeline.withColumns({"level": F.when(same, F.col("level")).otherwise(level_of_rate(rate)), "rate": F.when(same, F.col("rate")).otherwise(rate)})


#: Days of convective weather that must be on record before the slope of growth counts.
CONVECTIVE_DAYS = 3


def gate_passes(logged_days: Column, required: int = CONVECTIVE_DAYS) -> Column:
    """Whether growth may change timelines: enough convective days are on record."""
    return logged_days >= required
