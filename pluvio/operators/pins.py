"""Samples around pins. Pins and samples meet by shared cells of a coarse grid, never pair by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions import geo
from pluvio.functions.classify import level_of_rate, rate_of_sample
from pluvio.functions.const import HORIZON_MIN, LOCAL_KM, OVER_KM, TIMELINE_STEP, TRACK_KM
from pluvio.operators.spatial import range_join


def newest(samples: DataFrame) -> DataFrame:
    """The samples of the newest frame."""
    last = samples.agg(F.max("frame_time").alias("frame_time"))
    return samples.join(F.broadcast(last), "frame_time", "left_semi")  # one row


def within(samples: DataFrame, pins: DataFrame, km: float) -> DataFrame:
    """Each pin with each sample at most ``km`` away, and ``km``; of the pin's own frame where pins have a ``frame_time``."""
    points = samples.select("frame_time", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "level", "rate")
    return range_join(pins, points, km, ("lat", "lon"), ("s_lat", "s_lon"), ("frame_time",) if "frame_time" in pins.columns else ())


def neighbourhood(samples: DataFrame, pins: DataFrame) -> DataFrame:
    """What lies around each pin in each frame; a pin without echo within 100 km has zeros and no distance. The pin's class is that of the mean rate within 8 km."""
    every = pins.crossJoin(samples.select("frame_time").distinct())  # the answer has a row for each pin and frame
    near = within(samples, pins.select("pin_id", "lat", "lon"), TRACK_KM)
    rate = rate_of_sample(F.col("rate"), F.col("level"))
    over, local = F.col("km") <= OVER_KM, F.col("km") <= LOCAL_KM
    sums = near.groupBy("frame_time", "pin_id").agg(
        F.max(F.when(local, F.col("level"))).alias("max_level"), F.max(F.when(over, F.col("level"))).alias("pin_max_level"), F.max(F.when(over, rate)).alias("pin_max_rate"),
        F.avg(F.when(over, rate)).alias("pin_rate"), F.min("km").alias("nearest_km"),
    )
    zero = {"max_level": 0, "pin_max_level": 0, "pin_max_rate": 0.0, "pin_rate": 0.0}
    return every.join(sums, ["frame_time", "pin_id"], "left").fillna(zero, list(zero)).withColumn("pin_level", level_of_rate(F.col("pin_rate")))


def observed(samples: DataFrame, pins: DataFrame) -> DataFrame:
    """The highest class within 8 km of each pin in every frame."""
    frames = samples.select("frame_time").distinct()
    wet = within(samples, pins.select("pin_id", "lat", "lon"), OVER_KM).groupBy("pin_id", "frame_time").agg(F.max("level").alias("obs"))
    every = pins.select("pin_id").crossJoin(frames)  # the answer has a row for each pin and frame
    return every.join(wet, ["pin_id", "frame_time"], "left").fillna(0, ["obs"])


def lattice(origins: DataFrame) -> DataFrame:
    """168 pins from each origin (``origin, lat, lon``) to the north and east, 0.45 by 0.7 degrees apart: ``origin, pin_id, lat, lon``."""
    at = F.col("pin_id")
    rows = origins.select("origin", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.explode(F.sequence(F.lit(0), F.lit(12 * 14 - 1))).alias("pin_id"))
    return rows.select("origin", "pin_id", geo.half_up(F.col("o_lat") + F.floor(at / 14) * 0.45, 2).alias("lat"), geo.half_up(F.col("o_lon") + at % 14 * 0.7, 2).alias("lon"))


def correlation_centre(samples: DataFrame, pins: DataFrame) -> DataFrame:
    """The nearest echo to each pin in each frame, or, if farther than 25 km, the point 20 km behind it."""
    near = within(samples, pins.select("pin_id", "lat", "lon"), TRACK_KM)
    order = F.struct("km", (-F.col("level")).alias("l"), "s_lat", "s_lon", "lat", "lon")
    best = near.groupBy("frame_time", "pin_id").agg(F.min(order).alias("b")).select("frame_time", "pin_id", "b.*")
    lat, lon = geo.destination("s_lat", "s_lon", geo.bearing("lat", "lon", "s_lat", "s_lon"), 20.0)
    far = F.col("km") > 25
    return best.select("frame_time", "pin_id", F.when(far, lat).otherwise(F.col("s_lat")).alias("lat"), F.when(far, lon).otherwise(F.col("s_lon")).alias("lon"))


def persistence(samples: DataFrame, pins: DataFrame) -> DataFrame:
    """The timeline without motion, from the samples of one frame: the mean rate within 6 km at every step, unknown off the composite."""
    near = within(samples, pins.select("pin_id", "lat", "lon"), OVER_KM * 0.75)
    rate = near.groupBy("pin_id").agg(F.avg(rate_of_sample(F.col("rate"), F.col("level"))).alias("r"))
    known = geo.covered("lat", "lon")
    found = pins.join(rate, "pin_id", "left").select("pin_id", F.when(known, F.coalesce("r", F.lit(0.0))).otherwise(0.0).alias("r"), (~known).alias("unknown"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(HORIZON_MIN), F.lit(TIMELINE_STEP)))
    return found.select("pin_id", steps.alias("t"), level_of_rate(F.col("r")).alias("level"), geo.half_up(F.col("r"), 1).alias("rate"), "unknown")


def tiles(boxes: DataFrame, zoom: int, most: int = 24) -> DataFrame:
    """``box, x, y``: the map tiles that cover each box (``box, min_lat, max_lat, min_lon, max_lon``), by column and row, ``most`` at most."""
    corner = lambda lat, lon: tuple(F.floor(v) for v in geo.tile(lon, lat, zoom))
    (x0, y0), (x1, y1) = corner("max_lat", "min_lon"), corner("min_lat", "max_lon")
    grid = boxes.select("box", F.explode(F.sequence(x0, x1)).alias("x"), y0.alias("y0"), y1.alias("y1")).select("box", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
    order = Window.partitionBy("box").orderBy("x", "y")
    return grid.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def first_by(df: DataFrame, keys: list[str], *order: F.Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
