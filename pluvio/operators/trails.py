"""Masses through time: matches of consecutive frames, trails, their motion and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions import geo
from pluvio.functions.const import GATE_SECONDS, MATCH_KM, MAX_SPEED, MIN_SPEED
from pluvio.operators.masses import overlap
from pluvio.operators.pins import first_by
from pluvio.operators.stages import written


#: What a trail is known by: the scan, and the mass of the scan's newest frame.
TRACK = ("scan_time", "trail_id")


def one_scan(frames: DataFrame) -> DataFrame:
    """``scan_time, frame_time``: all frames as one scan, named by the newest."""
    times = frames.select("frame_time").distinct()
    return times.crossJoin(F.broadcast(times.agg(F.max("frame_time").alias("scan_time"))))  # one row


def rolling_scans(frames: DataFrame, n: int = 4) -> DataFrame:
    """``scan_time, frame_time``: each frame that has ``n - 1`` before it, with these, as a scan."""
    order = Window.orderBy("frame_time").rowsBetween(1 - n, 0)  # one row a frame
    held = frames.select("frame_time").distinct().withColumn("held", F.collect_list("frame_time").over(order)).where(F.size("held") == n)
    return held.select(F.col("frame_time").alias("scan_time"), F.explode("held").alias("frame_time"))


def ends_of(scans: DataFrame, frames: DataFrame) -> DataFrame:
    """``scan_time, since, last_time`` of each scan: its first frame, and the newest that has echo (``frames``)."""
    usable = scans.join(frames.select("frame_time").distinct(), "frame_time", "left_semi")
    since = scans.groupBy("scan_time").agg(F.min("frame_time").alias("since"))
    return since.join(usable.groupBy("scan_time").agg(F.max("frame_time").alias("last_time")), "scan_time")


def gate(km: float, seconds: Column) -> Column:
    """A distance for 30 minutes, scaled to other times."""
    return F.when(seconds > 0, F.lit(km) * seconds / float(GATE_SECONDS)).otherwise(0.0)


def frame_pairs(frames: DataFrame) -> DataFrame:
    """Each frame time with the one before: ``frame_time, prev_time, dt``. One row a frame."""
    order = Window.orderBy("frame_time")
    return frames.select("frame_time").distinct().withColumn("prev_time", F.lag("frame_time").over(order)).where("prev_time is not null").withColumn("dt", F.col("frame_time") - F.col("prev_time"))


def matches(members: DataFrame, found: DataFrame, times: DataFrame) -> DataFrame:
    """For each mass the one of the frame before that it continues: centres within the gate, then ten times the overlap plus what the gate leaves."""
    prev = found.select(F.col("frame_time").alias("prev_time"), F.col("mass_id").alias("prev_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("max_level").alias("p_level"))
    pairs = found.join(times, "frame_time").join(prev, "prev_time").withColumn("d", geo.haversine("lat", "lon", "p_lat", "p_lon")).withColumn("gate", gate(MATCH_KM, F.col("dt"))).where("d <= gate")
    scored = pairs.join(overlap(members, times), ["frame_time", "prev_time", "mass_id", "prev_id"], "left").withColumn("score", F.coalesce("hits", F.lit(0)) * 10 + (F.col("gate") - F.col("d")))
    best = first_by(scored, ["frame_time", "mass_id"], F.desc("score"), F.desc("p_level"), F.col("prev_id"))
    return best.select("frame_time", "mass_id", "prev_time", "prev_id", "d", "dt", "score")


def trails(found: DataFrame, matched: DataFrame, scans: DataFrame) -> DataFrame:
    """The trail of each mass of each scan's newest frame: ``scan_time, trail_id, frame_time, mass_id, lat, lon, n, max_level, mean_level``.

    Masses and matches are those of frames, so that scans which share frames share them. A trail
    ends where there is no match, where a hop is faster than 95 km/h, or with the scan's first
    frame, however many frames that is: trails grow by doubling. ``jump`` leads from a mass to what
    it was 2^k frames before, and in each round every mass on the way so far jumps, which doubles
    the way; so the joins are as many as the longest scan's frames have binary digits.
    """
    jump = matched.where(F.col("d") / (F.col("dt") / 3600.0) <= MAX_SPEED).select("frame_time", "mass_id", "prev_time", "prev_id")
    ends = ends_of(scans, found)
    way = found.select("frame_time", "mass_id", F.col("mass_id").alias("trail_id")).join(ends, F.col("frame_time") == F.col("last_time")).select("scan_time", "since", "trail_id", "frame_time", "mass_id")
    longest = scans.groupBy("scan_time").count().agg(F.max("count")).first()[0] or 0  # one number
    reach = 1
    while reach < longest:
        step = way.join(jump, ["frame_time", "mass_id"]).where("prev_time >= since").select("scan_time", "since", "trail_id", F.col("prev_time").alias("frame_time"), F.col("prev_id").alias("mass_id"))
        way, reach = way.unionByName(step), reach * 2
        if reach < longest:
            # Read twice from here on.
            way = written(way)
            further = jump.toDF("prev_time", "prev_id", "then_time", "then_id")
            jump = written(jump.join(further, ["prev_time", "prev_id"]).select("frame_time", "mass_id", F.col("then_time").alias("prev_time"), F.col("then_id").alias("prev_id")))
    return way.drop("since").join(found, ["frame_time", "mass_id"])


def circular_mean(degrees: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean direction; null if no weight is positive."""
    w = F.when(weight > 0, weight)
    x, y = F.sum(w * F.cos(F.radians(degrees))), F.sum(w * F.sin(F.radians(degrees)))
    return F.when(F.sum(w) > 0, F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0)))


def trail_motion(trail: DataFrame) -> DataFrame:
    """Speed between a trail's ends, and a bearing from all its hops and, weighed more, its ends."""
    by = Window.partitionBy(*TRACK).orderBy("frame_time")
    whole = Window.partitionBy(*TRACK).orderBy("frame_time").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = trail.select(*TRACK, "frame_time", "lat", "lon").withColumns({"n": F.count("*").over(whole), "first": F.first(F.struct("frame_time", "lat", "lon")).over(whole), "last": F.last(F.struct("frame_time", "lat", "lon")).over(whole), "prev": F.lag(F.struct("frame_time", "lat", "lon")).over(by)})
    ends = geo.haversine("first.lat", "first.lon", "last.lat", "last.lon")
    rows = rows.withColumns({"moved": ends, "hours": (F.col("last.frame_time") - F.col("first.frame_time")) / 3600.0, "bearing_all": geo.bearing("first.lat", "first.lon", "last.lat", "last.lon")})
    hop = rows.where("prev is not null").withColumns({"step": geo.haversine("prev.lat", "prev.lon", "lat", "lon"), "turn": geo.bearing("prev.lat", "prev.lon", "lat", "lon"), "h": (F.col("frame_time") - F.col("prev.frame_time")) / 3600.0})
    wild = (F.col("n") >= 3) & (F.col("moved") > 8) & (geo.angle_between(F.col("turn"), F.col("bearing_all")) > 70)
    hop = hop.where((F.col("step") / F.col("h") <= MAX_SPEED) & ~wild).select(*TRACK, F.col("turn").alias("deg"), F.greatest("step", F.lit(0.5)).alias("w"))
    head = rows.where("prev is null and n >= 2").select(*TRACK, "n", "moved", "hours", F.col("bearing_all").alias("deg"), (F.greatest("moved", F.lit(1.0)) * F.when(F.col("n") >= 3, 2.0).otherwise(1.0)).alias("w"), F.col("first.lat").alias("from_lat"), F.col("first.lon").alias("from_lon"))
    turns = hop.unionByName(head.select(*TRACK, "deg", "w")).groupBy(*TRACK).agg(circular_mean(F.col("deg"), F.col("w")).alias("bearing"))
    speed = F.col("moved") / F.col("hours")
    return head.where(speed <= MAX_SPEED).join(turns, list(TRACK)).select(*TRACK, "n", "moved", (F.col("hours") * 3600).alias("seconds"), speed.alias("speed"), "bearing", "from_lat", "from_lon")


def trend(trail: DataFrame) -> DataFrame:
    """``growing``, ``decaying`` or null for each trail: class and area vote, first snap against last."""
    snap = lambda f: f(F.struct("max_level", "mean_level", "n"), "frame_time")
    ends = trail.groupBy(*TRACK).agg(snap(F.min_by).alias("a"), snap(F.max_by).alias("b"), F.count("*").alias("snaps"))
    top, mean, area = F.col("b.max_level") - F.col("a.max_level"), F.col("b.mean_level") - F.col("a.mean_level"), (F.col("b.n") - F.col("a.n")) / F.col("a.n")
    up, down, wider, smaller = (top >= 1) | (mean >= 0.35), (top <= -1) | (mean <= -0.35), area >= 0.25, area <= -0.25
    grow, decay = up.cast("int") + wider.cast("int"), down.cast("int") + smaller.cast("int")
    word = F.when(F.col("snaps") < 2, None).when((top >= 1) & ~down, "growing").when((top <= -1) & ~up, "decaying")
    word = word.when((grow > decay) & (up | (wider & (mean >= 0))), "growing").when((decay > grow) & (down | (smaller & (mean <= 0))), "decaying")
    return ends.select(*TRACK, word.alias("trend"))


def track(lat: Column, lon: Column, bearing: Column, speed: Column) -> dict[str, Column]:
    """An arrow: a little behind, and where the mass will be in half an hour."""
    moving = speed >= MIN_SPEED
    look = F.when(moving, speed * 0.5).otherwise(0.0)
    back = F.when(moving, F.least(speed / 6.0, look * 0.35)).otherwise(8.0)
    b_lat, b_lon = geo.destination(lat, lon, F.pmod(bearing + 180.0, F.lit(360.0)), F.greatest(back, F.lit(4.0)))
    s_lat, s_lon = geo.destination(lat, lon, bearing, look)
    return {"back_lat": b_lat, "back_lon": b_lon, "soon_lat": F.when(moving, s_lat).otherwise(lat), "soon_lon": F.when(moving, s_lon).otherwise(lon)}


def closest_approach(rows: DataFrame) -> DataFrame:
    """``rows`` (lat, lon, bearing, speed, pin_lat, pin_lon) with ``miss_km`` and ``miss_min``: the nearest of 46 points along the way, at 8 km/h or more; the earliest of equals."""
    speed = F.greatest("speed", F.lit(8.0))

    def at(t: Column) -> Column:
        lat, lon = geo.destination("lat", "lon", "bearing", speed * t / 60.0)
        return F.struct(geo.haversine("pin_lat", "pin_lon", lat, lon).alias("d"), t.alias("t"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(90), F.lit(2)), at))
    return rows.withColumn("__b", best).withColumn("miss_km", F.col("__b.d")).withColumn("miss_min", F.col("__b.t")).drop("__b")
