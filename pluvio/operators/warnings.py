"""Official warnings and lightning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.operators.cover import counties_of
from pluvio.operators.pins import first_by
from pluvio.operators.spatial import range_join


def storm_related(event: Column) -> Column:
    e = F.lower(event)
    return e.contains("burz") | e.contains("grad") | e.contains("silny deszcz") | e.contains("deszcz z burz")


def short_event(event: Column) -> Column:
    e = F.lower(event)
    return F.when(e.contains("burz"), "burze").when(e.contains("grad"), "grad").when(e.contains("deszcz"), "deszcz").otherwise(e)


def county_code(raw: Column) -> Column:
    """The first four digits, or null."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.substring(digits, 1, 4))


def warsaw(raw: Column) -> Column:
    """A Warsaw wall-clock string as a UTC timestamp; null if it is none."""
    text = F.replace(F.trim(raw), F.lit("T"), F.lit(" "))
    return F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))), "Europe/Warsaw")


def is_live(ends: Column, now: Column) -> Column:
    """Not over yet; an unreadable end counts as live."""
    return F.coalesce(now <= ends, F.lit(True))


def is_active(starts: Column, ends: Column, now: Column) -> Column:
    """From half an hour before the start to the end; unreadable bounds count as active."""
    return F.coalesce((now >= starts - F.expr("interval 30 minutes")) & (now <= ends), F.lit(True))


def degrees_by_county(warnings: DataFrame) -> DataFrame:
    """Highest degree of the live storm warnings of each county."""
    return warnings.select("degree", F.explode("teryt").alias("raw")).withColumn("teryt", county_code(F.col("raw"))).where("teryt is not null").groupBy("teryt").agg(F.max("degree").alias("degree"))


def in_polygon(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``pin_id, code``: the county of each point (``pin_id, lat, lon``) that lies in one.

    ``edges`` has a row for each edge of each ring: ``code, ring`` (0 is the outer one), the edge's
    ends ``x1, y1, x2, y2`` and the county's box, and ``part`` where a county has several polygons.
    A point lies in a polygon if its ray crosses the outer ring an odd number of times and every
    other ring an even number; of several counties the one of the smallest box counts. Points and
    polygons meet by the cells that cover these (``cover``).
    """
    return counties_of(points, edges)


def county_label(name: Column) -> Column:
    """A county's name with what it is before it, once."""
    return F.when(F.startswith(name, F.lit("powiat ")), name).otherwise(F.concat(F.lit("powiat "), name))


def lanes(pins: DataFrame, warnings: DataFrame, now: Column) -> DataFrame:
    """``pin_id, id, lane``: for each pin (``pin_id, terc, county``) the line about the first live storm warning of its county, by ``ordinal``, the place in the feed. A pin without one has no row."""
    live = warnings.where(F.col("storm") & is_live(F.col("ends"), now)).select("id", "ordinal", "event", F.explode(F.array_distinct("teryt")).alias("terc"))
    first = first_by(pins.join(live, "terc"), ["pin_id"], F.col("ordinal"), F.col("id"))
    return first.select("pin_id", "id", F.concat(F.lit("Ostrzeżenie IMGW: "), short_event(F.col("event")), F.lit(" · "), county_label(F.col("county"))).alias("lane"))


def nearest_city(points: DataFrame, cities: DataFrame, km: float = 30.0) -> DataFrame:
    """The code of the nearest city within ``km`` of each point; of equals the last listed."""
    listed = cities.select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "terc", "place")
    near = range_join(points.select("pin_id", "lat", "lon"), listed, km)
    return first_by(near, ["pin_id"], F.col("km"), F.desc("place")).select("pin_id", "terc")


def opacity(age_min: Column) -> Column:
    """How a strike fades over 15 minutes."""
    return F.when(age_min < 0, 0.95).when(age_min > 15, 0.0).otherwise(0.95 - 0.8 * age_min / 15.0)


def county_features(counties: DataFrame, degrees: DataFrame) -> DataFrame:
    """``t, feature``: each county (``t, n, g``: polygons of rings of points) with a degree, as GeoJSON; one polygon alone is a ``Polygon``."""
    found = counties.join(degrees.where("degree > 0"), F.col("t") == F.col("teryt"))
    properties = F.struct("t", "n", "degree")
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.element_at("g", 1).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("g").alias("coordinates")))
    geometry = F.when(F.size("g") == 1, one).otherwise(many)
    return found.select("t", F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), geometry, F.lit("}")).alias("feature"))


# Short names of days from Sunday on, and of months.
DAYS = ("niedz.", "pon.", "wt.", "śr.", "czw.", "pt.", "sob.")
MONTHS = ("sty", "lut", "mar", "kwi", "maj", "cze", "lip", "sie", "wrz", "paź", "lis", "gru")


def warning_time(raw: Column) -> Column:
    """A Warsaw wall-clock string in words; as it is where it is no time."""
    at = F.from_utc_timestamp(warsaw(raw), "Europe/Warsaw")
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i)
    text = F.concat(name(DAYS, F.dayofweek(at)), F.lit(", "), F.dayofmonth(at).cast("string"), F.lit(" "), name(MONTHS, F.month(at)), F.lit(", "), F.date_format(at, "HH:mm"))
    return F.coalesce(text, raw)


def warning_range(starts: Column, ends: Column, now: Column) -> Column:
    """From when to when a warning holds: by today and tomorrow where that will do. ``now`` is in UTC."""
    local = lambda raw: F.from_utc_timestamp(warsaw(raw), "Europe/Warsaw")
    today = F.to_date(F.from_utc_timestamp(now, "Europe/Warsaw"))

    def day(raw: Column) -> Column:
        off = F.datediff(F.to_date(local(raw)), today)
        return F.when(off == 0, "dziś").when(off == 1, "jutro")

    hour = lambda raw: F.date_format(local(raw), "HH:mm")
    one = F.concat(day(starts), F.lit(" "), hour(starts), F.lit("–"), hour(ends))
    two = F.concat(day(starts), F.lit(" "), hour(starts), F.lit(" – "), day(ends), F.lit(" "), hour(ends))
    far = F.concat(warning_time(starts), F.lit(" – "), warning_time(ends))
    return F.coalesce(F.when(day(starts) == day(ends), one), two, far)


def strike_features(strikes: DataFrame, now: Column) -> DataFrame:
    """``strike_id, feature`` of strikes (strike_id, ts, lat, lon) that have not faded yet, as GeoJSON points with their opacity."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60e6
    seen = strikes.withColumn("opacity", opacity(age)).where("opacity > 0")
    shape = F.struct(F.lit("Feature").alias("type"), F.struct("opacity").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    return seen.select("strike_id", F.to_json(shape).alias("feature"))
