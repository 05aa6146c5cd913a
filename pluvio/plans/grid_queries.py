"""Rasters, frames, grids and what lies near a pin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions import geo
from pluvio.operators import grid, pins
from pluvio.plans import sqltext as S
from pluvio.plans.fixtures import PINS, Scene, hits_sql
from pluvio.plans.registry import query

PIN_SQL = PINS.format(nation="nation")


def samples_sql(most: int = 9000, frames: int = 7, peaked: bool = False) -> str:
    """CTEs ending in ``samples``."""
    return f"""h as ({hits_sql(frames, peaked)}),
fac as (select unnest([1, 2, 4, 8]) as factor),
cells as (select frame_time, factor, floor((lat - 48.8e0) / (0.027e0 * factor)) as i, floor((lon - 13.8e0) / (0.044e0 * factor)) as j, max(rate) as rate from h, fac group by all),
cnt as (select frame_time, factor, count(*) as n from cells group by all),
pickf as (select frame_time, coalesce(min(factor) filter (n <= {most}), 8) as factor from cnt group by frame_time),
samples as (select * from (select frame_time, {S.half_up('48.8e0 + (i + 0.5e0) * (0.027e0 * factor)', 3)} as lat, {S.half_up('13.8e0 + (j + 0.5e0) * (0.044e0 * factor)', 3)} as lon,
 {S.level('rate')} as level, {S.half_up('rate', 1)} as rate, 3e0 * factor as cell_km from cells join pickf using (frame_time, factor)) q where level > 0)"""


def samples(s: Scene, most: int = 9000, frames: int = 7, peaked: bool = False) -> DataFrame:
    return grid.aggregate(s.hits(frames, peaked), most)


@query(f"with {samples_sql()} select * from samples")
def grid_aggregate(s: Scene) -> DataFrame:
    return samples(s)


@query(f"with {samples_sql(60)} select frame_time, cell_km, count(*) as n, max(level) as max_level from samples group by all")
def grid_coarsen(s: Scene) -> DataFrame:
    """Frames held to 60 cells, so that they coarsen."""
    return samples(s, 60).groupBy("frame_time", "cell_km").agg(F.count("*").alias("n"), F.max("level").alias("max_level"))


@query(f"with {samples_sql()}, o as (select *, row_number() over (partition by frame_time order by level desc, lat, lon) as place from samples) select frame_time, place, level, lat, lon from o")
def sample_order(s: Scene) -> DataFrame:
    """The samples of each frame in the order that settles ties."""
    order = Window.partitionBy("frame_time").orderBy(F.desc("level"), "lat", "lon")
    return samples(s).withColumn("place", F.row_number().over(order)).select("frame_time", "place", "level", "lat", "lon")


@query(f"with {samples_sql(peaked=True)} select frame_time, count(*) filter (level >= 1) as wet from samples group by frame_time having count(*) filter (level >= 1) > 0")
def usable_frames(s: Scene) -> DataFrame:
    return samples(s, peaked=True).groupBy("frame_time").agg(F.count_if(F.col("level") >= 1).alias("wet")).where("wet > 0")


@query(f"with {samples_sql(100)}, n as (select frame_time, count(*) as n from samples group by all) select list_sort(list(distinct cell_km)) as cell_kms, (select min(n) from n) as least, (select max(n) from n) as most from samples")
def frame_stats(s: Scene) -> DataFrame:
    per = samples(s, 100).groupBy("frame_time").agg(F.count("*").alias("n"), F.collect_set("cell_km").alias("kms"))
    return per.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("kms")))).alias("cell_kms"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(f"with h as ({hits_sql()}) select event_id, lat, lon from h where lat between 48.8e0 and 55.15e0 and lon between 13.8e0 and 24.6e0")
def bbox_filter(s: Scene) -> DataFrame:
    return grid.in_bbox(s.hits()).select("event_id", "lat", "lon")


_PIX = S.unproject("gl + (c + 0.5e0) * gw", "gt - (r + 0.5e0) * gh")


@query(f"""with g as ({S.georef(8)}), e as (select vec_id, label, unnest(embedding) as raw, generate_subscripts(embedding, 1) - 1 as i from embeddings),
v as (select vec_id, i, i % 8 as c, i // 8 as r, case when label = 0 and i % 9 = 0 then -2e0 else floor(cast(raw as double) * 1000 + 0.5e0) / 100e0 end as raw from e)
select vec_id, cast(i as int) as i, {S.half_up('raw', 2)} as rate, {S.half_up(_PIX[0], 6)} as lat, {S.half_up(_PIX[1], 6)} as lon from v, g where raw <> -2e0 and raw <> -1e0 and raw >= 0.1e0""")
def sri_hits(s: Scene) -> DataFrame:
    """Hits of rasters of eight by eight pixels: without no-data and undetected ones, and from 0.1 mm/h."""
    pixels = s.table("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    raw = F.when((F.col("label") == 0) & (F.col("i") % 9 == 0), -2.0).otherwise(geo.half_up(F.col("v").cast("double") * 1000) / 100.0)
    wet = pixels.withColumn("raw", raw).where((F.col("raw") != -2) & (F.col("raw") != -1) & (F.col("raw") >= 0.1))
    lat, lon = geo.pixel_centre(F.col("i") % 8, F.floor(F.col("i") / 8), 8)
    return wet.select("vec_id", "i", geo.half_up(F.col("raw"), 2).alias("rate"), geo.half_up(lat, 6).alias("lat"), geo.half_up(lon, 6).alias("lon"))


@query(f"with {samples_sql()}, p as ({PIN_SQL}) select pin_id, frame_time, count(*) as n from samples s join p on {S.km('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 25 group by all")
def within_radius(s: Scene) -> DataFrame:
    return pins.within(samples(s), s.pins(), 25.0).groupBy("pin_id", "frame_time").agg(F.count("*").alias("n"))


_KM = S.km("s.lat", "s.lon", "p.lat", "p.lon")


@query(f"""with {samples_sql()}, p as ({PIN_SQL}), last as (select max(frame_time) as t from samples), d as (select pin_id, level, coalesce(rate, 0) as rate, {_KM} as km from p left join (select * from samples, last where frame_time = t) s on {_KM} <= 100)
select pin_id, coalesce(max(level) filter (km <= 25), 0) as max_level, coalesce(max(level) filter (km <= 8), 0) as pin_max_level, coalesce(max(rate) filter (km <= 8), 0) as pin_max_rate,
 {S.level('coalesce(avg(rate) filter (km <= 8), 0)')} as pin_level, {S.half_up('min(km)', 6)} as nearest_km from d group by pin_id""")
def pin_neighbourhood(s: Scene) -> DataFrame:
    return pins.neighbourhood(pins.newest(samples(s)), s.pins()).withColumn("nearest_km", geo.half_up(F.col("nearest_km"), 6)).select("pin_id", "max_level", "pin_max_level", "pin_max_rate", "pin_level", "nearest_km")


@query(f"with {samples_sql(peaked=True)}, p as ({PIN_SQL}), f as (select distinct frame_time from samples) select pin_id, f.frame_time, coalesce(max(level), 0) as obs from p cross join f left join samples s on s.frame_time = f.frame_time and {_KM} <= 8 group by all")
def obs_level(s: Scene) -> DataFrame:
    return pins.observed(samples(s, peaked=True), s.pins())


@query(f"select p.pin_id as origin, cast(i * 14 + j as int) as pin_id, {S.half_up('p.lat + i * 0.45e0', 2)} as lat, {S.half_up('p.lon + j * 0.7e0', 2)} as lon from ({PIN_SQL}) p, range(12) a(i), range(14) b(j)")
def pin_lattice(s: Scene) -> DataFrame:
    """The lattice of pins from each of the pins on."""
    return pins.lattice(s.pins().select(F.col("pin_id").alias("origin"), "lat", "lon"))


_IN = S.turn("plat", "plon", "slat", "slon")
_STEP = S.dest("slat", "slon", _IN, "20e0")


@query(f"""with {samples_sql()}, p as ({PIN_SQL}), last as (select max(frame_time) as t from samples), d as (select pin_id, p.lat as plat, p.lon as plon, s.lat as slat, s.lon as slon, {_KM} as km, row_number() over (partition by pin_id order by {_KM}, level desc, s.lat, s.lon) as rn from p, last join samples s on frame_time = t where {_KM} <= 100)
select pin_id, {S.half_up(f'case when km > 25 then {_STEP[0]} else slat end', 5)} as lat, {S.half_up(f'case when km > 25 then {_STEP[1]} else slon end', 5)} as lon from d where rn = 1""")
def ncc_center(s: Scene) -> DataFrame:
    """Where the regional correlation is centred: the nearest echo, or 20 km beyond it if it is farther than 25 km."""
    return pins.correlation_centre(pins.newest(samples(s)), s.pins()).select("pin_id", geo.half_up(F.col("lat"), 5).alias("lat"), geo.half_up(F.col("lon"), 5).alias("lon"))


_SPINE = "(select unnest(range(0, 91, 5)) as t)"
_COV = S.project("p.lat", "p.lon")


@query(f"""with {samples_sql()}, p as ({PIN_SQL}), g as ({S.georef()}), last as (select max(frame_time) as ft from samples),
c as (select pin_id, p.lat, p.lon, ({_COV[0]} - gl) / gw as cc, (gt - {_COV[1]}) / gh as rr from p, g), d as (select pin_id, avg(rate) as rate from p, last join samples s on frame_time = ft where {_KM} <= 6 group by pin_id)
select pin_id, cast(t as int) as t, {S.level('coalesce(rate, 0)')} * cast(cc >= 0 and cc < 800 and rr >= 0 and rr < 800 as int) as level, case when cc >= 0 and cc < 800 and rr >= 0 and rr < 800 then {S.half_up('coalesce(rate, 0)', 1)} else 0 end as rate, not (cc >= 0 and cc < 800 and rr >= 0 and rr < 800) as unknown from c left join d using (pin_id) cross join {_SPINE}""")
def pin_timeline_persistence(s: Scene) -> DataFrame:
    """Rain at each pin over 90 minutes if nothing moves."""
    return pins.persistence(pins.newest(samples(s)), s.pins())


@query(f"with {samples_sql()}, t as (select distinct frame_time from samples order by frame_time desc limit 4) select frame_time from t")
def latest_n_frames(s: Scene) -> DataFrame:
    return samples(s).select("frame_time").distinct().orderBy(F.desc("frame_time")).limit(4)


def _row(lat: str) -> str:
    return f"cast(floor((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * 128e0) as bigint)"


_COLUMN = "cast(floor(({lon} + 180) / 360 * 128) as bigint)"


@query(f"""with b as (select pin_id as box, lat - 1.9e0 as a, lat + 1.9e0 as b, lon - 2.4e0 as c, lon + 2.4e0 as d from ({PIN_SQL}) p),
x as (select box, a, b, unnest(range({_COLUMN.format(lon='c')}, {_COLUMN.format(lon='d')} + 1)) as x from b), y as (select box, x, unnest(range({_row('b')}, {_row('a')} + 1)) as y from x)
select box, x, y from (select *, row_number() over (partition by box order by x, y) as n from y) q where n <= 5""")
def tile_cover(s: Scene) -> DataFrame:
    """Tiles at zoom 7 that cover a box around each pin, five at most."""
    around = {"min_lat": F.col("lat") - 1.9, "max_lat": F.col("lat") + 1.9, "min_lon": F.col("lon") - 2.4, "max_lon": F.col("lon") + 2.4}
    return pins.tiles(s.pins().select(F.col("pin_id").alias("box"), *[c.alias(n) for n, c in around.items()]), 7, 5)


@query(f"with {samples_sql(peaked=True)}, f as (select frame_time, count(*) as n, max(level) as m, max(cell_km) as km from samples group by all), l as (select *, lag(frame_time) over (order by frame_time) as prev_time, row_number() over (order by frame_time desc) as rn from f) select frame_time as latest_time, prev_time, n as echo_count, m as max_level, km as cell_km, case when km <= 3 then 2 end as ncc_cell_km from l where rn = 1")
def scan_summary(s: Scene) -> DataFrame:
    """The newest frame of a scan with the one before it."""
    frames = samples(s, peaked=True).groupBy("frame_time").agg(F.count("*").alias("echo_count"), F.max("level").alias("max_level"), F.max("cell_km").alias("cell_km"))
    two = frames.orderBy(F.desc("frame_time")).limit(2)
    newest = two.agg(F.max("frame_time").alias("latest_time"), F.min("frame_time").alias("prev_time"), *[F.max_by(c, "frame_time").alias(c) for c in ("echo_count", "max_level", "cell_km")])
    return newest.withColumn("prev_time", F.when(F.col("prev_time") < F.col("latest_time"), F.col("prev_time"))).withColumn("ncc_cell_km", F.when(F.col("cell_km") <= 3, 2))


