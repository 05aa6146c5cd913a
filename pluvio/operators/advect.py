"""Rain carried to the pin: motion at a place, departure points and the 90-minute timeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo
from pluvio.functions.classify import level_of_rate, rate_of_sample
from pluvio.functions.const import FIELD_CELLS, HORIZON_MIN, IDW_CUTOFF_KM, NCC_CELL_KM, OVER_KM, TIMELINE_STEP, TRACK_KM
from pluvio.operators.pins import within

HALF = FIELD_CELLS // 2


#: A motion that is known at a place.
ANCHOR = "array<struct<lat:double,lon:double,u:double,v:double>>"


def with_anchors(rows: DataFrame, anchors: DataFrame | None) -> DataFrame:
    """``rows`` (frame_time, ...) with ``anchors``, those of their frame (``frame_time, lat, lon, u, v``), in order; none without a table.

    A frame's anchors are its moving masses, of which a frame of 9,000 cells has some hundreds at
    most, so that they go along with each row and no place needs a join to be looked up.
    """
    if anchors is None:
        return rows.withColumn("anchors", F.array().cast(ANCHOR))
    of = anchors.select("frame_time", F.struct(*[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "u", "v")]).alias("a")).groupBy("frame_time").agg(F.sort_array(F.collect_list("a")).alias("anchors"))
    return rows.join(of, "frame_time", "left").withColumn("anchors", F.coalesce("anchors", F.array().cast(ANCHOR)))


def mean_motion(lat: Column, lon: Column) -> Column:
    """The mean motion (u, v) of the ``anchors`` within 80 km of a place, by inverse squared distance; null if none."""
    away = F.transform("anchors", lambda a: F.struct(a["u"].alias("u"), a["v"].alias("v"), geo.haversine(lat, lon, a["lat"], a["lon"]).alias("km")))
    near = F.transform(F.filter(away, lambda a: a["km"] <= IDW_CUTOFF_KM), lambda a: F.struct(a["u"].alias("u"), a["v"].alias("v"), (1.0 / (a["km"] * a["km"] + 1.0)).alias("w")))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("u", "v", "w")])
    added = lambda s, a: F.struct((s["u"] + a["w"] * a["u"]).alias("u"), (s["v"] + a["w"] * a["v"]).alias("v"), (s["w"] + a["w"]).alias("w"))
    return F.aggregate(near, zero, added, lambda s: F.when(s["w"] > 0, F.struct((s["u"] / s["w"]).alias("u"), (s["v"] / s["w"]).alias("v"))))


def interpolated(points: DataFrame, anchors: DataFrame, at: tuple[str, str] = ("m_lat", "m_lon")) -> DataFrame:
    """``points`` (frame_time, a place) with ``u, v``, the mean motion there (``mean_motion``) of their frame's anchors."""
    found = with_anchors(points, anchors).withColumn("m", mean_motion(F.col(at[0]), F.col(at[1])))
    return found.withColumns({"u": F.col("m.u"), "v": F.col("m.v")}).drop("m", "anchors")


def cell_of(lat: Column, lon: Column, pin_lat: Column, pin_lon: Column, km: Column | float = NCC_CELL_KM) -> tuple[Column, Column]:
    """Column and row of a place on the grid around a pin."""
    return geo.half_up((lon - pin_lon) / geo.lon_degrees(km, pin_lat)) + HALF, geo.half_up((lat - pin_lat) / geo.lat_degrees(km)) + HALF


def with_motion(rows: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """``rows`` (pin_lat, pin_lon, anchors, background) with ``m``, the motion (u, v) at a place: that of its cell of the grid around the pin, or off the grid its own; the background, which may be null, where no anchor is near. The grid's cells are those of ``field_km``, 3 km without such a column.

    The field is never stored: a cell's motion is computed at its centre, for the cells that are asked for.
    """
    pin_lat, pin_lon = F.col("pin_lat"), F.col("pin_lon")
    km = F.col("field_km") if "field_km" in rows.columns else F.lit(NCC_CELL_KM)
    ix, iy = cell_of(lat, lon, pin_lat, pin_lon, km)
    inside = (ix >= 0) & (iy >= 0) & (ix < FIELD_CELLS) & (iy < FIELD_CELLS)
    at_lat = F.when(inside, pin_lat + (iy - HALF) * geo.lat_degrees(km)).otherwise(lat)
    at_lon = F.when(inside, pin_lon + (ix - HALF) * geo.lon_degrees(km, pin_lat)).otherwise(lon)
    found = rows.withColumns({"m_lat": at_lat, "m_lon": at_lon})
    return found.withColumn("m", F.coalesce(mean_motion(F.col("m_lat"), F.col("m_lon")), F.col("background"))).drop("m_lat", "m_lon")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def carried_to(lat: Column, lon: Column, m: Column, minutes: Column, back: bool = False) -> Column:
    """``lat, lon`` of a place moved by ``m`` (u, v) for some minutes, or, if ``m`` is under 0.1 km/h or null, null."""

    def go(way: Column) -> Column:
        turn = F.pmod(way["turn"] + (180.0 if back else 0.0), F.lit(360.0))
        to_lat, to_lon = geo.destination(lat, lon, turn, way["speed"] * minutes / 60.0)
        return F.when(way["speed"] >= 0.1, F.struct(to_lat.alias("lat"), to_lon.alias("lon")))

    def way(v: Column) -> Column:
        turn, speed = geo.from_uv(v["u"], v["v"])
        return bound(F.struct(turn.alias("turn"), speed.alias("speed")), go)

    return bound(m, way)


def departures(rows: DataFrame, anchors: DataFrame | None = None, steps: int = 3) -> DataFrame:
    """``rows`` (frame_time, pin_lat, pin_lon, background, t, and ``anchors`` or a table of them) with ``at_lat, at_lon``, whence the air over the pin left ``t`` minutes ago; three fixed-point steps, fewer where it stands still."""
    rows = rows if "anchors" in rows.columns else with_anchors(rows, anchors)
    found = rows.withColumns({"at_lat": F.col("pin_lat").cast("double"), "at_lon": F.col("pin_lon").cast("double"), "go": F.col("t") > 0})
    for _ in range(steps):
        found = with_motion(found, F.col("at_lat"), F.col("at_lon"))
        to = F.when(F.col("go"), carried_to(F.col("pin_lat"), F.col("pin_lon"), F.col("m"), F.col("t"), back=True))
        found = found.withColumn("to", to).withColumns({"at_lat": F.coalesce("to.lat", "at_lat"), "at_lon": F.coalesce("to.lon", "at_lon"), "go": F.col("to").isNotNull()}).drop("to", "m")
    return found.drop("go", "anchors")


def timeline(samples: DataFrame, pins: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """``frame_time, pin_id, t, level, rate, unknown`` over 90 minutes, for ``pins`` (frame_time, pin_id, pin_lat, pin_lon, background, moving, and ``field_km``, the cells of the frame's motion field) and the samples of their frames.

    Each sample within 108 km moves with the motion of its place; the mean rate of those that reach
    the pin counts. Where nothing is ``moving``, and now, it is the mean around the pin. Off the
    composite and without arrivals a step is unknown.
    """
    key = ["frame_time", "pin_id"]
    pins = pins.select(*key, "pin_lat", "pin_lon", "background", "moving", (F.col("field_km") if "field_km" in pins.columns else F.lit(NCC_CELL_KM)).alias("field_km"))
    pins = with_anchors(pins, anchors)
    # No place that is asked for lies farther than the fastest motion goes, or than a sample may be away; its anchors are 80 km from there, and a cell's width.
    speed = lambda m: F.sqrt(m["u"] * m["u"] + m["v"] * m["v"])
    fastest = F.greatest(F.coalesce(F.array_max(F.transform("anchors", speed)), F.lit(0.0)), F.coalesce(speed(F.col("background")), F.lit(0.0)))
    farthest = F.greatest(fastest * HORIZON_MIN / 60.0, F.lit(TRACK_KM + OVER_KM)) + IDW_CUTOFF_KM + 2 * F.col("field_km")
    pins = pins.withColumn("farthest", farthest).withColumn("anchors", F.filter("anchors", lambda a: geo.haversine("pin_lat", "pin_lon", a["lat"], a["lon"]) <= F.col("farthest"))).drop("farthest")
    steps = F.explode(F.sequence(F.lit(0), F.lit(HORIZON_MIN), F.lit(TIMELINE_STEP))).alias("t")
    at = departures(pins.select("*", steps))
    away = F.when(F.col("moving") & (F.col("t") > 0), geo.haversine("pin_lat", "pin_lon", "at_lat", "at_lon")).otherwise(0.0)
    at = at.withColumns({"reach": OVER_KM * 0.75 + F.least(0.15 * away, F.lit(6.0)), "known": geo.covered("at_lat", "at_lon")}).drop("background", "field_km")
    near = within(samples, pins.withColumns({"lat": F.col("pin_lat"), "lon": F.col("pin_lon")}), TRACK_KM + OVER_KM)
    near = with_motion(near, F.col("s_lat"), F.col("s_lon")).select(*key, "s_lat", "s_lon", rate_of_sample(F.col("rate"), F.col("level")).alias("r"), "m", "km")
    # A sample can only arrive at a step by which it may have come as far as it is.
    fastest = F.coalesce(F.sqrt(F.pow("m.u", 2) + F.pow("m.v", 2)), F.lit(0.0))
    joined = near.join(at, key).where(F.when(F.col("moving") & (F.col("t") > 0) & (fastest >= 0.1), F.col("km") <= fastest * F.col("t") / 60.0 + F.col("reach") + 0.01).otherwise(True))
    to = F.when(F.col("moving") & (F.col("t") > 0), carried_to(F.col("s_lat"), F.col("s_lon"), F.col("m"), F.col("t")))
    d = bound(to, lambda x: F.when(x.isNotNull(), geo.haversine(x["lat"], x["lon"], "pin_lat", "pin_lon")).otherwise(geo.haversine("s_lat", "s_lon", "at_lat", "at_lon")))
    mean = joined.withColumn("d", d).where("d <= reach").groupBy(*key, "t").agg(F.avg("r").alias("r"))
    found = at.join(mean, [*key, "t"], "left")
    lost = ~F.col("known") & (F.col("r").isNull() | ~F.col("moving") | (F.col("t") == 0))
    rate = F.when(lost, 0.0).otherwise(F.coalesce("r", F.lit(0.0)))
    return found.select(*key, "t", level_of_rate(rate).alias("level"), geo.half_up(rate, 1).alias("rate"), lost.alias("unknown"))
