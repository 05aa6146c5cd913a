"""Rain masses: connected samples of a frame, split where several cores stand out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions import geo
from pluvio.functions.const import CORE_LEVEL, CORE_RADIUS_KM, LINK_KM, MIN_MASS, ORIGIN_LAT, ORIGIN_LON, TRACK_KM
from pluvio.operators.pins import first_by
from pluvio.operators.spatial import links, range_join


def numbered(samples: DataFrame) -> DataFrame:
    """Samples with ``sample_id``, their place in the order that settles ties within a frame (a frame has at most as many samples as the grid allows)."""
    order = Window.partitionBy("frame_time").orderBy(F.desc("level"), "lat", "lon")
    return samples.withColumn("sample_id", F.row_number().over(order))


def link_pairs(samples: DataFrame, km: float = LINK_KM) -> DataFrame:
    """``frame_time, a, b, km`` of samples of one frame at most ``km`` apart."""
    return links(samples.where("level >= 1").select("frame_time", "sample_id", "lat", "lon"), km, "sample_id", ("frame_time",))


def strict_cores(samples: DataFrame, km: float = LINK_KM) -> DataFrame:
    """Samples of class 3 or more without a neighbour as strong."""
    cores = samples.where(F.col("level") >= CORE_LEVEL)
    near = samples.select("frame_time", F.col("sample_id").alias("o"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.col("level").alias("o_level"))
    beaten = range_join(cores, near, km, on=("frame_time",)).where("o <> sample_id and o_level >= level").select("frame_time", "sample_id").distinct()
    return cores.join(beaten, ["frame_time", "sample_id"], "left_anti")


def _union(pairs: pd.DataFrame) -> pd.DataFrame:
    """Least label of each linked sample of one frame."""
    ids, flat = np.unique(pairs[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return pd.DataFrame({"frame_time": pairs["frame_time"].iloc[0], "sample_id": ids, "component": ids[label]})
        label = new


def components(samples: DataFrame) -> DataFrame:
    """Wet samples with ``component``, the least ``sample_id`` that links reach.

    Links are found by an equi-join on cells; one frame's links, which the grid bounds, are then
    joined up in a task.
    """
    found = link_pairs(samples).select("frame_time", "a", "b").groupBy("frame_time").applyInPandas(_union, "frame_time long, sample_id int, component int")
    wet = samples.where("level >= 1")
    return wet.join(found, ["frame_time", "sample_id"], "left").withColumn("component", F.coalesce("component", "sample_id"))


def masses(samples: DataFrame) -> DataFrame:
    """Samples of masses with ``mass_id``.

    Components of under three samples are dropped. One with two strict cores or more is dealt to
    the nearest core (the first of equals); parts of at least twelve samples are masses, or if none
    is that large, the whole component if it is.
    """
    size = Window.partitionBy("frame_time", "component")
    found = components(samples).withColumn("n", F.count("*").over(size)).where("n >= 3")
    cores = strict_cores(samples).select("frame_time", "sample_id").join(found.select("frame_time", "sample_id", "component", "lat", "lon"), ["frame_time", "sample_id"])
    cores = cores.select("frame_time", "component", F.col("sample_id").alias("core"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")).withColumn("cores", F.count("*").over(size)).where("cores >= 2")
    near = F.struct(geo.haversine("lat", "lon", "c_lat", "c_lon").alias("d"), F.col("core").alias("core"))
    parts = found.join(cores, ["frame_time", "component"]).groupBy("frame_time", "sample_id").agg(F.min(near)["core"].alias("core"))
    dealt = found.join(parts, ["frame_time", "sample_id"], "left").withColumn("part_n", F.count("*").over(Window.partitionBy("frame_time", "component", "core")))
    dealt = dealt.withColumn("best", F.max(F.when(F.col("core").isNotNull(), F.col("part_n"))).over(size))
    split = F.coalesce(F.col("best") >= MIN_MASS, F.lit(False))
    mass = F.when(split & (F.col("part_n") >= MIN_MASS), F.col("core")).when(~split & (F.col("n") >= MIN_MASS), F.col("component"))
    return dealt.withColumn("mass_id", mass).where("mass_id is not null").select(*samples.columns, "mass_id")


def _weighted(x: str) -> Column:
    return F.sum(F.col(x) * F.col("level")) / F.sum("level")


def summary(members: DataFrame) -> DataFrame:
    """Centre weighted by class, size, highest and mean class of each mass."""
    return members.groupBy("frame_time", "mass_id").agg(_weighted("lat").alias("lat"), _weighted("lon").alias("lon"), F.count("*").alias("n"), F.max("level").alias("max_level"), F.avg("level").alias("mean_level"))


def anchors(members: DataFrame) -> DataFrame:
    """Where an arrow begins: the weighted centre of the strong samples (all, if under three) within 18 km of the strongest, or of all of these if fewer than three are."""
    mass = Window.partitionBy("frame_time", "mass_id")
    pool = members.withColumn("strong", F.count_if(F.col("level") >= 2).over(mass)).where("strong < 3 or level >= 2")
    first = mass.orderBy(F.desc("level"), "lat", "lon")
    seeded = pool.withColumn("seed", F.first(F.struct("lat", "lon")).over(first)).withColumn("near", geo.haversine("seed.lat", "seed.lon", "lat", "lon") <= CORE_RADIUS_KM)
    local = seeded.withColumn("local", F.count_if(F.col("near")).over(mass)).where("near or local < 3")
    return local.groupBy("frame_time", "mass_id").agg(_weighted("lat").alias("lat"), _weighted("lon").alias("lon"))


def ranked(found: DataFrame, lat: float, lon: float) -> DataFrame:
    """Masses of each frame by strength, size and distance to the origin: ``place``."""
    order = Window.partitionBy("frame_time").orderBy(F.desc("max_level"), F.desc("n"), geo.haversine("lat", "lon", lat, lon), "mass_id")
    return found.withColumn("place", F.row_number().over(order))


def pin_mass(members: DataFrame, found: DataFrame, pins: DataFrame) -> DataFrame:
    """The mass of each frame that is nearest to each pin within 100 km, by its nearest sample: ``frame_time, pin_id, mass_id, d``."""
    points = members.select("frame_time", "mass_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    d = range_join(pins.select("pin_id", "lat", "lon"), points, TRACK_KM).groupBy("frame_time", "pin_id", "mass_id").agg(F.min("km").alias("d"))
    place = ranked(found, ORIGIN_LAT, ORIGIN_LON).select("frame_time", "mass_id", "place")
    return first_by(d.join(place, ["frame_time", "mass_id"]), ["frame_time", "pin_id"], F.col("d"), F.col("place")).drop("place")


def overlap(members: DataFrame, times: DataFrame) -> DataFrame:
    """For masses of consecutive frames (``times``: frame_time, prev_time), the members of the later one with a member of the earlier within 6.5 km."""
    later = members.join(times, "frame_time").select("frame_time", "prev_time", "mass_id", "sample_id", "lat", "lon")
    earlier = members.select(F.col("frame_time").alias("prev_time"), F.col("mass_id").alias("prev_id"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    pairs = range_join(later, earlier, LINK_KM, on=("prev_time",))
    return pairs.groupBy("frame_time", "prev_time", "mass_id", "prev_id").agg(F.countDistinct("sample_id").alias("hits"))
