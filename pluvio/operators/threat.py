"""What each pin has to expect from each scan: masses, motion and field once a scan, then all pins at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions import geo
from pluvio.functions.classify import rate_of_dbz
from pluvio.functions.const import CONFIDENCE_MIN, FROM_PL, HAIL_DBZ, MIN_MASS, MIN_SPEED, NCC_CELL_KM, OVER_KM, PIN_KM, REGIONAL_MIN, STRIKE_KM, TOWARD_PL, TRACK_KM, TRAIL_SOLO_KM, TRAIL_TRUST_KM
from pluvio.operators import advect as A
from pluvio.operators import decision as D
from pluvio.operators import growth as G
from pluvio.operators import masses as M
from pluvio.operators import motion as N
from pluvio.operators import pins as P
from pluvio.operators import trails as T
from pluvio.operators import warnings as W
from pluvio.operators.spatial import range_join
from pluvio.operators.stages import written

POINT = "struct<t:int,level:int,rate:double,unknown:boolean>"


@dataclass
class Echo:
    """Masses of frames and their trails in scans. What scans share is there once."""

    samples: DataFrame
    scans: DataFrame
    ends: DataFrame
    members: DataFrame
    summary: DataFrame
    matched: DataFrame
    trails: DataFrame


def echo(samples: DataFrame, scans: DataFrame) -> Echo:
    """``samples`` (frame_time, lat, lon, level, rate, cell_km) of all frames; ``scans`` (scan_time, frame_time)."""
    samples = written(samples.where("level >= 1"))
    scans = written(scans)
    members = written(M.masses(written(M.numbered(samples))))
    summary = written(M.summary(members))
    matched = written(T.matches(members, summary, T.frame_pairs(samples)))
    return Echo(samples, scans, written(T.ends_of(scans, samples)), members, summary, matched, written(T.trails(summary, matched, scans)))


def cell_km(e: Echo) -> DataFrame:
    """``scan_time, cell_km, motion_km`` of each scan: the widest cells of its frames, and those of motion, which are finer where the frames say so (``ncc_cell_km``)."""
    finer = F.col("ncc_cell_km") if "ncc_cell_km" in e.samples.columns else F.lit(None).cast("double")
    frames = e.samples.groupBy("frame_time").agg(F.max("cell_km").alias("cell_km"), F.max(finer).alias("ncc_cell_km"))
    wide = e.scans.join(frames, "frame_time").groupBy("scan_time").agg(F.coalesce(F.max(F.when(F.col("cell_km") > 0, F.col("cell_km"))), F.lit(NCC_CELL_KM)).alias("cell_km"), F.max(F.when(F.col("ncc_cell_km") > 0, F.col("ncc_cell_km"))).alias("fine"))
    return wide.select("scan_time", "cell_km", F.coalesce("fine", "cell_km").alias("motion_km"))


def regional_motion(e: Echo, pins: DataFrame) -> DataFrame:
    """``scan_time, pin_id, speed, bearing, confidence`` of all echo around each pin."""
    last = e.samples.join(e.ends.select(F.col("last_time").alias("frame_time")).distinct(), "frame_time", "left_semi")
    centre = P.correlation_centre(last, pins).select(F.col("frame_time").alias("last_time"), "pin_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    centre = centre.join(e.ends.select("scan_time", "last_time"), "last_time").drop("last_time")
    points = e.samples.join(e.scans, "frame_time").select("scan_time", "frame_time", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "level")
    cells = written(cell_km(e))
    widest = cells.agg(F.max("motion_km")).first()[0] or NCC_CELL_KM  # one number
    near = range_join(centre, points, N.reach_km(widest), ("c_lat", "c_lon"), on=("scan_time",)).join(cells, "scan_time")
    near = near.select("scan_time", "pin_id", "frame_time", F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), "level", "c_lat", "c_lon", F.col("motion_km").alias("own_km"))
    return N.motions(near, ["scan_time", "pin_id"], F.col("own_km"))


def mass_motion(e: Echo) -> DataFrame:
    """``scan_time, trail_id, speed, bearing, confidence, from_lat, from_lon``: the trail's motion and the correlation's, where they agree or one stands alone."""
    trail, key = e.trails, list(T.TRACK)
    rows = trail.select(*key, "frame_time", "mass_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")).join(e.members, ["frame_time", "mass_id"])
    part = Window.partitionBy(*key, "frame_time")
    rows = rows.withColumn("strong", F.count_if(F.col("level") >= 2).over(part)).where(f"strong < {MIN_MASS} or level >= 2")
    rows = rows.withColumn("close", geo.haversine("t_lat", "t_lon", "lat", "lon") <= 40).withColumn("n_close", F.count_if(F.col("close")).over(part)).where("close or n_close < 5")
    last = e.summary.join(e.ends, F.col("frame_time") == F.col("last_time")).select("scan_time", F.col("mass_id").alias("trail_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    rows = rows.join(last, key).join(cell_km(e), "scan_time").select(*key, "frame_time", "lat", "lon", "level", "c_lat", "c_lon", F.col("motion_km").alias("own_km"))
    field = N.motions(rows, key, F.col("own_km")).select(*key, F.col("speed").alias("f_speed"), F.col("bearing").alias("f_bearing"), F.col("confidence").alias("fc"))
    both = T.trail_motion(trail).join(field, key, "left")
    trust = (F.col("speed") >= MIN_SPEED) & (F.col("moved") >= T.gate(TRAIL_TRUST_KM, F.col("seconds")))
    sure = F.coalesce(F.col("f_speed") >= MIN_SPEED, F.lit(False))
    agree = geo.angle_between(F.col("bearing"), F.col("f_bearing")) <= 40
    hops = F.least("n", F.lit(4))
    joint = F.least(F.lit(98), geo.half_up(58 + hops * 8 + F.least("moved", F.lit(40.0)) * 0.4 + (F.col("fc") - 40) * 0.35))
    alone = F.least(F.lit(78), geo.half_up(50 + hops * 6 + F.least("moved", F.lit(35.0)) * 0.45))
    x = 1.4 * F.cos(F.radians("bearing")) + F.cos(F.radians("f_bearing"))
    y = 1.4 * F.sin(F.radians("bearing")) + F.sin(F.radians("f_bearing"))
    mean = F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))
    solo = trust & ~sure & (F.col("n") >= 3) & (F.col("moved") >= T.gate(TRAIL_SOLO_KM, F.col("seconds")))
    grid = sure & ~trust & (F.col("n") >= 3) & (F.col("fc") >= CONFIDENCE_MIN)
    pick = lambda a, b, c: F.when(trust & sure & agree, a).when(solo, b).when(grid, c)
    out = both.select(*key, pick((F.col("speed") + F.col("f_speed")) / 2, F.col("speed"), F.col("f_speed")).alias("speed"), pick(mean, F.col("bearing"), F.col("f_bearing")).alias("bearing"), pick(joint, alone, F.col("fc")).cast("int").alias("confidence"), "from_lat", "from_lon")
    return out.where("speed is not null")


def moving_masses(e: Echo) -> DataFrame:
    """The newest frame's masses whose motion is sure enough to be drawn: with ``lat, lon, max_level``, motion, and the anchor ``now_lat, now_lon`` of their arrow."""
    last = e.summary.join(e.ends, F.col("frame_time") == F.col("last_time")).withColumnRenamed("mass_id", "trail_id")
    now = M.anchors(e.members).select("frame_time", F.col("mass_id").alias("trail_id"), F.col("lat").alias("now_lat"), F.col("lon").alias("now_lon"))
    sure = mass_motion(e).where((F.col("speed") >= MIN_SPEED) & (F.col("confidence") >= CONFIDENCE_MIN))
    return last.join(sure, ["scan_time", "trail_id"]).join(now, ["frame_time", "trail_id"])


def tracks(moving: DataFrame, most: int = 3) -> DataFrame:
    """The arrows drawn for each scan: the surest masses, of equals the stronger; the first is the threatening one."""
    order = Window.partitionBy("scan_time").orderBy(F.desc("confidence"), F.desc("max_level"), "trail_id")
    ranked = moving.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    arrow = T.track(F.col("now_lat"), F.col("now_lon"), F.col("bearing"), F.col("speed"))
    return ranked.select("scan_time", "trail_id", "place", (F.col("place") == 1).alias("threatening"), "now_lat", "now_lon", *[c.alias(n) for n, c in arrow.items()], "speed", "bearing", "confidence")


def track_union(drawn: DataFrame, own: DataFrame) -> DataFrame:
    """``drawn`` arrows of a scan and, for each pin, its ``own`` (scan_time, pin_id, trail_id, now_lat, now_lon) where none drawn begins within 1e-5 degrees of it: ``scan_time, pin_id, trail_id, pinned``."""
    beside = own.join(drawn.select("scan_time", F.col("now_lat").alias("d_lat"), F.col("now_lon").alias("d_lon")), "scan_time").where((F.abs(F.col("d_lat") - F.col("now_lat")) < 1e-5) & (F.abs(F.col("d_lon") - F.col("now_lon")) < 1e-5))
    extra = own.join(beside.select("scan_time", "pin_id"), ["scan_time", "pin_id"], "left_anti")
    each = drawn.select("scan_time", "trail_id").join(own.select("scan_time", "pin_id").distinct(), "scan_time")
    return each.select("scan_time", "pin_id", "trail_id", F.lit(False).alias("pinned")).unionByName(extra.select("scan_time", "pin_id", "trail_id", F.lit(True).alias("pinned")))


def tracks_on_map(drawn: DataFrame, toggles: DataFrame) -> DataFrame:
    """``drawn`` arrows of the scans whose map shows them: ``toggles`` has ``scan_time, shown``; without a row, or where it is null, none are shown."""
    return drawn.join(toggles.where("shown").select("scan_time").distinct(), "scan_time", "left_semi")


def _approach(e: Echo, moving: DataFrame, pins: DataFrame) -> DataFrame:
    """Each moving mass within 100 km of each pin: its distance, whether it comes or goes, and how near it will pass."""
    points = e.members.join(e.ends, F.col("frame_time") == F.col("last_time")).select("scan_time", F.col("mass_id").alias("trail_id"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    close = range_join(pins.select("pin_id", F.col("lat").alias("pin_lat"), F.col("lon").alias("pin_lon")), points, TRACK_KM, ("pin_lat", "pin_lon")).groupBy("scan_time", "pin_id", "pin_lat", "pin_lon", "trail_id").agg(F.min("km").alias("d_now"))
    rows = T.closest_approach(close.join(moving, ["scan_time", "trail_id"]))
    ahead = geo.destination("lat", "lon", "bearing", 15.0)
    rows = rows.withColumns({"d_ahead": geo.haversine("pin_lat", "pin_lon", *ahead), "d_then": geo.haversine("pin_lat", "pin_lon", "from_lat", "from_lon")})
    now, front, then = F.col("d_now"), F.col("d_ahead"), F.col("d_then")
    return rows.withColumns({"approaching": (front < now - 0.4) | (now < then - 0.6), "receding": (front > now + 0.4) & (now > then + 0.6)})


def primary(e: Echo, moving: DataFrame, pins: DataFrame) -> DataFrame:
    """The mass that matters to each pin in each scan, the nearest; the miss is the least of all within 100 km."""
    rows = _approach(e, moving, pins).withColumn("least_miss", F.min("miss_km").over(Window.partitionBy("scan_time", "pin_id")))
    best = P.first_by(rows, ["scan_time", "pin_id"], F.col("d_now"), F.desc("confidence"), F.desc("max_level"), F.col("trail_id"))
    return best.select("scan_time", "pin_id", "trail_id", "approaching", "receding", F.col("least_miss").alias("miss_km"), (F.col("miss_km") <= PIN_KM).alias("mass_hit"), F.col("miss_min").alias("mass_eta"), "speed", "bearing", F.col("max_level").alias("mass_level"), "now_lat", "now_lon")


def _trends(e: Echo, pins: DataFrame) -> DataFrame:
    """Of the mass nearest to each pin, moving or not: whether it grows."""
    nearest = P.first_by(M.pin_mass(e.members, e.summary, pins).join(e.ends, F.col("frame_time") == F.col("last_time")), ["scan_time", "pin_id"], F.col("d"))
    return nearest.select("scan_time", "pin_id", F.col("mass_id").alias("trail_id")).join(T.trend(e.trails), list(T.TRACK), "left").select("scan_time", "pin_id", F.col("trail_id").alias("pin_trail"), F.col("trend").alias("cell_trend"))


def _lightning(e: Echo, scene: DataFrame, strikes: DataFrame | None) -> DataFrame:
    """``scan_time, pin_id`` where a strike of the scan (scan_time, lat, lon) lies within 20 km of the pin's mass, or, without one, of its nearest echo."""
    if strikes is None:
        return scene.select("scan_time", "pin_id").where("false")
    last = e.samples.join(e.ends.select("scan_time", F.col("last_time").alias("frame_time")), "frame_time").select("scan_time", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    lone = scene.where("now_lat is null")
    near = range_join(lone.select("scan_time", "pin_id", "pin_lat", "pin_lon"), last, TRACK_KM, ("pin_lat", "pin_lon"), on=("scan_time",))
    echo_ = near.groupBy("scan_time", "pin_id").agg(F.min(F.struct("km", "s_lat", "s_lon")).alias("e")).select("scan_time", "pin_id", F.col("e.s_lat").alias("x_lat"), F.col("e.s_lon").alias("x_lon"))
    cells = scene.where("now_lat is not null").select("scan_time", "pin_id", F.col("now_lat").alias("x_lat"), F.col("now_lon").alias("x_lon")).unionByName(echo_)
    hit = range_join(cells, strikes.select("scan_time", F.col("lat").alias("k_lat"), F.col("lon").alias("k_lon")), STRIKE_KM, ("x_lat", "x_lon"), ("k_lat", "k_lon"), ("scan_time",))
    return hit.select("scan_time", "pin_id").distinct()


def _warned(scans: DataFrame, pins: DataFrame, warnings: DataFrame | None, now: Column) -> DataFrame:
    """Of each pin's storm warnings at the time of each scan: whether one is active, whether another is not, the highest degree of the active ones (1 at least), and the body of the first in the feed (``ordinal``; without it, of the least id)."""
    if warnings is None or "terc" not in pins.columns:
        kinds = "scan_time long, pin_id long, active boolean, upcoming boolean, degree int, body string"
        return scans.sparkSession.createDataFrame([], kinds)
    place = F.col("ordinal") if "ordinal" in warnings.columns else F.lit(0)
    own = warnings.where("storm").withColumn("__place", place).withColumn("code", F.explode(F.array_distinct("teryt")))
    own = P.first_by(own, ["id", "code"], F.col("__place"))
    rows = pins.select("pin_id", "terc").join(own, F.col("terc") == F.col("code")).crossJoin(scans.select("scan_time").distinct())  # few are of one county; the answer is by scan
    on = W.is_active(F.col("starts"), F.col("ends"), now)
    rows = rows.select("scan_time", "pin_id", "id", "degree", "body", on.alias("on"), F.struct("__place", "id").alias("place"))
    first = lambda cond: F.min_by(F.when(cond, F.col("body")), F.when(cond, F.col("place")))
    out = rows.groupBy("scan_time", "pin_id").agg(F.bool_or("on").alias("active"), F.bool_or(~F.col("on")).alias("upcoming"), F.max(F.when(F.col("on"), F.greatest(F.col("degree"), F.lit(1)))).cast("int").alias("degree"), F.coalesce(first(F.col("on")), first(~F.col("on"))).alias("body"))
    return out


def threats(e: Echo, pins: DataFrame, warnings: DataFrame | None = None, strikes: DataFrame | None = None, grow: bool = False) -> DataFrame:
    """One row for each pin (``pin_id, label, lat, lon``, and ``terc`` for warnings) and scan.

    ``warnings`` has ``id, degree, starts, ends, storm, teryt, body``; they are judged at the time
    of the scan. ``strikes`` has ``scan_time, lat, lon``. With ``grow`` the trend of the nearest
    mass is added to the timeline.

    Returns ``scan_time, pin_id, label, level, title, detail, eta, approaching, receding, speed_kmh,
    nearest_km, max_level, pin_level, cell_level, chance, coming_from, toward, will_hit, miss_km,
    expect, timeline, timeline_advected, lightning_near_cell, cell_trend, trail_id, now_lat, now_lon``.
    """
    last = e.samples.join(e.ends.select(F.col("last_time").alias("frame_time")).distinct(), "frame_time", "left_semi")
    around = P.neighbourhood(last, pins).withColumnRenamed("frame_time", "last_time").join(e.ends.select("scan_time", "last_time"), "last_time")
    moving = written(moving_masses(e))
    u, v = geo.to_uv(F.col("bearing"), F.col("speed"))
    anchors = moving.select(F.col("scan_time").alias("frame_time"), "lat", "lon", u.alias("u"), v.alias("v"))
    regional = regional_motion(e, pins).where((F.col("speed") >= MIN_SPEED) & (F.col("confidence") >= REGIONAL_MIN)).select("scan_time", "pin_id", F.col("speed").alias("r_speed"), F.col("bearing").alias("r_bearing"))
    key = ["scan_time", "pin_id"]
    field = cell_km(e).select("scan_time", F.col("cell_km").alias("field_km"))
    scene = around.join(primary(e, moving, pins), key, "left").join(regional, key, "left").join(field, "scan_time").join(moving.groupBy("scan_time").agg(F.count("*").alias("n_anchors")), "scan_time", "left")
    bu, bv = geo.to_uv(F.coalesce("r_bearing", "bearing"), F.coalesce("r_speed", "speed"))
    scene = scene.withColumns({"pin_lat": F.col("lat"), "pin_lon": F.col("lon"), "background": F.when(F.coalesce("r_speed", "speed").isNotNull(), F.struct(bu.alias("u"), bv.alias("v")))})
    scene = written(scene.withColumn("moving", F.col("n_anchors").isNotNull() | F.col("background").isNotNull()).drop("lat", "lon"))

    # Timelines are of scans here: the samples of a scan's last frame stand under the scan's time.
    own = last.join(e.ends.select("scan_time", F.col("last_time").alias("frame_time")), "frame_time").drop("frame_time").withColumnRenamed("scan_time", "frame_time")
    line = A.timeline(own, scene.withColumnRenamed("scan_time", "frame_time"), anchors).withColumnRenamed("frame_time", "scan_time")
    if grow:
        slopes = _trends(e, pins).select(*key, F.col("pin_trail").alias("trail_id")).join(G.growth(G.matched_cells(e.trails, e.members)), list(T.TRACK)).select(*key, "slope")
        line = G.grown(line.join(slopes, key, "left"), F.coalesce("slope", F.lit(0.0))).drop("slope")
    wet = (F.col("t") > 0) & ~F.col("unknown") & (F.col("level") >= 1)
    points = F.sort_array(F.collect_list(F.struct("t", "level", "rate", "unknown")))
    lines = line.groupBy(*key).agg(points.cast(f"array<{POINT}>").alias("timeline"), F.max("level").alias("tl_max"), F.min(F.when(wet, F.col("t"))).alias("first_wet"), F.bool_or("unknown").alias("left_coverage"))
    full = scene.join(lines, key).join(_warned(e.scans, pins, warnings, F.timestamp_seconds("scan_time")), key, "left").join(_trends(e, pins), key, "left")
    full = full.join(_lightning(e, scene, strikes).withColumn("lightning_near_cell", F.lit(True)), key, "left")
    full = full.fillna(False, ["approaching", "receding", "mass_hit", "active", "upcoming", "lightning_near_cell"]).fillna(0, ["mass_level"])

    over = F.coalesce(F.col("nearest_km") <= OVER_KM, F.lit(False)) & (F.col("pin_max_level") >= 1)
    field = F.col("moving")
    wets = field & F.col("first_wet").isNotNull()
    keep = ~field | F.col("left_coverage")
    full = full.withColumns({
        "eta": F.when(over, 0).when(wets, F.col("first_wet")).when(keep & field & F.col("mass_hit"), F.col("mass_eta")),
        "will_hit": over | wets | (keep & F.col("mass_hit")), "receding": F.col("receding") & ~over & ~wets, "approaching": F.col("approaching") | (wets & ~over),
        "mass_level": F.when(wets & ~over, F.greatest("mass_level", "tl_max")).otherwise(F.col("mass_level")), "mean_level": F.col("pin_level"), "timeline_advected": field,
        "speed_kmh": F.coalesce("speed", "r_speed"), "turn": F.coalesce("bearing", "r_bearing"),
    })
    full = full.withColumn("expect_level", D.expect_level(F.col("mass_level"), F.col("tl_max")))
    about = D.about_pin()
    words = lambda names: F.when(F.col("turn").isNotNull() & about, geo.compass(F.pmod(F.col("turn") + (180.0 if names is FROM_PL else 0.0), F.lit(360.0)), names))
    hail = F.col("pin_max_rate") >= rate_of_dbz(F.lit(float(HAIL_DBZ)))
    expect = F.when(about | (F.col("max_level") >= 1) | F.col("will_hit"), D.expect_words(F.col("expect_level"), hail))
    full = full.withColumns({"coming_from": words(FROM_PL), "toward": words(TOWARD_PL), "expect": expect})
    # The ladder and the cascade look at the strongest echo over the pin, words at the mean.
    judged = full.withColumn("pin_level", F.col("pin_max_level"))
    judged = judged.withColumns({"chance": D.chance(), "level": D.threat_level(F.col("active"), F.col("upcoming"))})
    judged = judged.withColumn("detail", D.detail())
    judged = judged.withColumn("pin_level", F.col("mean_level")).withColumn("title", D.title(F.col("level"), F.col("lightning_near_cell")))
    return judged.select(
        "scan_time", "pin_id", "label", "level", "title", "detail", "eta", "approaching", "receding", "speed_kmh", "nearest_km", "max_level", "pin_level", F.col("expect_level").alias("cell_level"), "chance", "coming_from", "toward",
        "will_hit", "miss_km", "expect", "timeline", "timeline_advected", "lightning_near_cell", "cell_trend", "trail_id", "now_lat", "now_lon",
    )
