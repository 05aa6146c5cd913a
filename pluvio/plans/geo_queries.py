"""Geometry, colours and classes, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions import classify, geo
from pluvio.functions.const import FROM_PL, NEAREST_COLOUR, NICE_METRES, PALETTE, RASTER, TOWARD_PL
from pluvio.plans import sqltext as S
from pluvio.plans.fixtures import PINS, Scene, hits_sql
from pluvio.plans.registry import query

HITS = hits_sql()
PIN_SQL = PINS.format(nation="nation")
#: Hits by pins, for formulas of two points.
BOTH = f"with h as ({HITS}), p as ({PIN_SQL}), x as (select h.event_id, p.pin_id, h.lat, h.lon, p.lat as plat, p.lon as plon from h join p on h.event_id % 25 = p.pin_id)"


def _both(s: Scene) -> DataFrame:
    pins = s.pins().select("pin_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return s.hits().withColumn("pin_id", (F.col("event_id") % 25).cast("int")).join(pins, "pin_id")


def _sql(columns: str) -> str:
    return f"{BOTH} select event_id, {columns} from x"


@query(_sql(S.half_up(S.km("lat", "lon", "plat", "plon"), 6) + " as km"))
def geo_haversine(s: Scene) -> DataFrame:
    return _both(s).select("event_id", geo.half_up(geo.haversine("lat", "lon", "plat", "plon"), 6).alias("km"))


_D = S.dest("lat", "lon", "(event_id % 360)", "(event_id % 120)")


@query(_sql(f"{S.half_up(_D[0], 6)} as to_lat, {S.half_up(_D[1], 6)} as to_lon"))
def geo_dest_point(s: Scene) -> DataFrame:
    lat, lon = geo.destination("lat", "lon", F.col("event_id") % 360, F.col("event_id") % 120)
    return _both(s).select("event_id", geo.half_up(lat, 6).alias("to_lat"), geo.half_up(lon, 6).alias("to_lon"))


@query(_sql(S.half_up(S.turn("lat", "lon", "plat", "plon"), 6) + " as bearing"))
def geo_bearing(s: Scene) -> DataFrame:
    return _both(s).select("event_id", geo.half_up(geo.bearing("lat", "lon", "plat", "plon"), 6).alias("bearing"))


def _eight(x: str) -> str:
    return f"(cast({S.half_up(f'({x}) / 45e0')} as bigint) % 8)"


@query(f"select event_id, {S.pick(FROM_PL, _eight('(event_id % 360 + 180) % 360'))} as coming_from, {S.pick(TOWARD_PL, _eight('event_id % 360'))} as toward from events")
def geo_compass(s: Scene) -> DataFrame:
    turn = (F.col("event_id") % 360).cast("double")
    return s.table("events").select("event_id", geo.compass(turn + 180.0, FROM_PL).alias("coming_from"), geo.compass(turn, TOWARD_PL).alias("toward"))


_T = S.turn("lat", "lon", "plat", "plon")
_L, _R = S.dest("plat", "plon", f"({_T} + 155)", "8e0"), S.dest("plat", "plon", f"({_T} - 155)", "8e0")


@query(_sql(f"{S.half_up(_L[0], 6)} as left_lat, {S.half_up(_L[1], 6)} as left_lon, {S.half_up(_R[0], 6)} as right_lat, {S.half_up(_R[1], 6)} as right_lon"))
def geo_arrow(s: Scene) -> DataFrame:
    """The two back corners of an arrow head of 8 km at the pin."""
    turn = geo.bearing("lat", "lon", "plat", "plon")
    left, right = geo.destination("plat", "plon", turn + 155.0, 8.0), geo.destination("plat", "plon", turn - 155.0, 8.0)
    named = zip((*left, *right), ("left_lat", "left_lon", "right_lat", "right_lon"), strict=True)
    return _both(s).select("event_id", *[geo.half_up(c, 6).alias(n) for c, n in named])


_XF = "((lon + 180e0) / 360e0 * 128e0)"
_YF = "((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 128e0)"


@query(_sql(f"cast(floor({_XF}) as bigint) as tx, cast(floor({_YF}) as bigint) as ty, {S.half_up(_XF, 6)} as xf, {S.half_up(_YF, 6)} as yf"))
def geo_tile(s: Scene) -> DataFrame:
    x, y = geo.tile("lon", "lat", 7)
    return _both(s).select("event_id", F.floor(x).alias("tx"), F.floor(y).alias("ty"), geo.half_up(x, 6).alias("xf"), geo.half_up(y, 6).alias("yf"))


_M = "(pi() * (1e0 - 2e0 * (40 + event_id % 8 + (event_id % 256) / 256e0) / 128e0))"


@query(
    f"select event_id, {S.half_up(f'degrees(atan((exp({_M}) - exp(-{_M})) / 2e0))', 6)} as lat,"
    f" {S.half_up('(68 + event_id % 9 + (event_id % 251) / 256e0) / 128e0 * 360e0 - 180e0', 6)} as lon from events"
)
def geo_tile_inverse(s: Scene) -> DataFrame:
    at = F.col("event_id")
    lat, lon = geo.tile_pixel(7, 68 + at % 9, 40 + at % 8, at % 251, at % 256)
    return s.table("events").select("event_id", geo.half_up(lat, 6).alias("lat"), geo.half_up(lon, 6).alias("lon"))


_B = "(event_id % 50 + 1)"


@query(_sql(", ".join(f"{S.half_up(x, 6)} as {n}" for x, n in ((f"lat - {_B} / 111.32e0", "min_lat"), (f"lat + {_B} / 111.32e0", "max_lat"), (f"lon - {_B} / (111.32e0 * cos(radians(lat)))", "min_lon"), (f"lon + {_B} / (111.32e0 * cos(radians(lat)))", "max_lon")))))
def geo_bbox(s: Scene) -> DataFrame:
    km = F.col("event_id") % 50 + 1
    up, side = km / 111.32, km / (111.32 * F.cos(F.radians("lat")))
    named = (("min_lat", F.col("lat") - up), ("max_lat", F.col("lat") + up), ("min_lon", F.col("lon") - side), ("max_lon", F.col("lon") + side))
    return _both(s).select("event_id", *[geo.half_up(c, 6).alias(n) for n, c in named])


_P = S.project("lat", "lon")
_U = S.unproject("x", "y")


@query(f"with h as ({HITS}), q as (select event_id, {_P[0]} as x, {_P[1]} as y from h) select event_id, {S.half_up('x', 3)} as x, {S.half_up('y', 3)} as y, {S.half_up(_U[0], 6)} as lat, {S.half_up(_U[1], 6)} as lon from q")
def aeqd_roundtrip(s: Scene) -> DataFrame:
    x, y = geo.project("lat", "lon")
    flat = s.hits().select("event_id", x.alias("x"), y.alias("y"))
    lat, lon = geo.unproject(F.col("x"), F.col("y"))
    return flat.select("event_id", geo.half_up(F.col("x"), 3).alias("x"), geo.half_up(F.col("y"), 3).alias("y"), geo.half_up(lat, 6).alias("lat"), geo.half_up(lon, 6).alias("lon"))


@query(f"""with q as (select event_id, (1 + event_id % 90) * sin(radians(event_id % 360)) as u, (1 + event_id % 90) * cos(radians(event_id % 360)) as v from events)
select event_id, {S.half_up('u', 6)} as u, {S.half_up('v', 6)} as v, {S.half_up(S.half_up('(degrees(atan2(u, v)) + 360e0) % 360e0', 6) + ' % 360e0', 5)} as bearing, {S.half_up('sqrt(u * u + v * v)', 6)} as speed from q""")
def uv_roundtrip(s: Scene) -> DataFrame:
    at = F.col("event_id")
    u, v = geo.to_uv((at % 360).cast("double"), (1 + at % 90).cast("double"))
    parts = s.table("events").select("event_id", u.alias("u"), v.alias("v"))
    turn, speed = geo.from_uv(F.col("u"), F.col("v"))
    return parts.select("event_id", geo.half_up(F.col("u"), 6).alias("u"), geo.half_up(F.col("v"), 6).alias("v"), geo.half_up(F.pmod(geo.half_up(turn, 6), F.lit(360.0)), 5).alias("bearing"), geo.half_up(speed, 6).alias("speed"))


_SIZES = "(select distinct p_size * 16 as n from part) r"


@query(f"select n, {S.half_up('gw', 3)} as width, {S.half_up('gh', 3)} as height, {S.half_up('gl', 3)} as x0, {S.half_up('gt', 3)} as y0 from ({S.georef('n').replace('select ', 'select n, ', 1)} from {_SIZES}) g")
def sri_georef(s: Scene) -> DataFrame:
    """Where the pixels of rasters of each size lie."""
    sizes = s.table("part").select((F.col("p_size") * 16).alias("n")).distinct()
    names = ("width", "height", "x0", "y0")
    return sizes.select("n", *[geo.half_up(c, 3).alias(k) for c, k in zip(geo.georeference(F.col("n")), names, strict=True)])


_C = S.unproject("gl + (c + 0.5e0) * gw", "gt - (r + 0.5e0) * gh")


@query(f"with g as ({S.georef()}), q as (select event_id, event_id * 7 % {RASTER} as c, event_id * 13 % {RASTER} as r from events) select event_id, {S.half_up(_C[0], 6)} as lat, {S.half_up(_C[1], 6)} as lon from q, g")
def sri_pixel_lonlat(s: Scene) -> DataFrame:
    lat, lon = geo.pixel_centre(F.col("event_id") * 7 % RASTER, F.col("event_id") * 13 % RASTER)
    return s.table("events").select("event_id", geo.half_up(lat, 6).alias("lat"), geo.half_up(lon, 6).alias("lon"))


_V = S.project("plat", "plon")


@query(f"with g as ({S.georef()}), p as (select event_id, 47e0 + event_id % 100 * 0.1e0 as plat, 10e0 + event_id % 170 * 0.1e0 as plon from events), q as (select event_id, ({_V[0]} - gl) / gw as c, (gt - {_V[1]}) / gh as r from p, g) select event_id, c >= 0 and c < {RASTER} and r >= 0 and r < {RASTER} as covered from q")
def coverage_mask(s: Scene) -> DataFrame:
    at = F.col("event_id")
    return s.table("events").select("event_id", geo.covered(47.0 + at % 100 * 0.1, 10.0 + at % 170 * 0.1).alias("covered"))


def _corner(right: str, down: str) -> str:
    lat, lon = S.unproject(f"gl + {right} * gw", f"gt - {down} * gh")
    return f"{S.half_up(lat, 6)} as lat, {S.half_up(lon, 6)} as lon"


@query(f"with g as ({S.georef()}) " + " union all ".join(f"select n, '{k}' as corner, {_corner(r, d)} from g, {_SIZES}" for k, r, d in (("tl", "0", "0"), ("tr", "n", "0"), ("br", "n", "n"), ("bl", "0", "n"))))
def overlay_corners(s: Scene) -> DataFrame:
    """The corners of overlays of so many of the raster's pixels, from its upper left one."""
    width, height, left, top = geo.georeference()
    n = F.col("n")

    def row(name: str, right: F.Column, down: F.Column) -> F.Column:
        lat, lon = geo.unproject(left + right * width, top - down * height)
        return F.struct(F.lit(name).alias("corner"), geo.half_up(lat, 6).alias("lat"), geo.half_up(lon, 6).alias("lon"))

    none = F.lit(0)
    corners = F.array(row("tl", none, none), row("tr", n, none), row("br", n, n), row("bl", none, n))
    return s.table("part").select((F.col("p_size") * 16).alias("n")).distinct().select("n", F.inline(corners))


@query(f"""with q as (select event_id, 156543.03392e0 * cos(radians(48 + event_id % 8)) / pow(2, 3 + event_id % 16) as m from events),
n as (select unnest([{', '.join(map(str, NICE_METRES))}]) as len),
b as (select event_id, m, len, row_number() over (partition by event_id order by abs(ln(len / greatest(1e0, m * 64))), len) as rn from q, n)
select event_id, case when len >= 1000 then cast(len // 1000 as varchar) || ' km' else cast(len as varchar) || ' m' end as label, cast({S.half_up('len / m')} as bigint) as width_px from b where rn = 1""")
def scale_bar(s: Scene) -> DataFrame:
    at = F.col("event_id")
    metres = 156543.03392 * F.cos(F.radians(48 + at % 8)) / F.pow(F.lit(2.0), 3 + at % 16)
    lengths = F.array(*map(F.lit, NICE_METRES))
    best = F.array_min(F.transform(lengths, lambda n: F.struct(F.abs(F.log(n / F.greatest(F.lit(1.0), F.col("m") * 64))).alias("d"), n.alias("n"))))["n"]
    label = F.when(F.col("n") >= 1000, F.concat((F.col("n") / 1000).cast("int").cast("string"), F.lit(" km"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" m")))
    return s.table("events").select("event_id", metres.alias("m")).withColumn("n", best).select("event_id", label.alias("label"), geo.half_up(F.col("n") / F.col("m")).alias("width_px"))


_COLOURS = ", ".join(f"({i}, {d}, {c})" for i, (d, c) in enumerate(PALETTE))
_PIXELS = f"""with pal(i, dbz, rgb) as (values {_COLOURS}),
px as (select p_partkey, least(255, (rgb // 65536) + p_partkey % 5) as r, least(255, (rgb // 256) % 256 + p_partkey % 7 * 4) as g, rgb % 256 as b, case when p_partkey % 11 = 0 then 100 else 255 end as a from part join pal on p_size % 52 = i)"""


def _pixels(s: Scene) -> DataFrame:
    shades = F.array(*[F.lit(c) for _, c in PALETTE])
    rgb, at = F.element_at(shades, (F.col("p_size") % 52 + 1).cast("int")), F.col("p_partkey")
    red, green = F.shiftright(rgb, 16) + at % 5, F.shiftright(rgb, 8).bitwiseAND(255) + at % 7 * 4
    return s.table("part").select("p_partkey", F.least(F.lit(255), red).alias("r"), F.least(F.lit(255), green).alias("g"), rgb.bitwiseAND(255).alias("b"), F.when(at % 11 == 0, 100).otherwise(255).alias("a"))


@query(f"""{_PIXELS}, d as (select p_partkey, a, pow(r - rgb // 65536, 2) + pow(g - (rgb // 256) % 256, 2) + pow(b - rgb % 256, 2) as d, i, dbz from px, pal),
n as (select p_partkey, a, d, dbz, row_number() over (partition by p_partkey order by d, i) as rn from d) select p_partkey, case when a >= 200 and d < {NEAREST_COLOUR**2} then dbz end as dbz from n where rn = 1""")
def palette_dbz(s: Scene) -> DataFrame:
    return classify.colours_to_dbz(_pixels(s)).select("p_partkey", "dbz")


@query(f"select p_partkey, {S.half_up('pow(pow(10e0, (p_size + 10) / 10e0) / 200e0, 1 / 1.6e0)', 6)} as rate from part")
def marshall_palmer(s: Scene) -> DataFrame:
    return s.table("part").select("p_partkey", geo.half_up(classify.rate_of_dbz(F.col("p_size") + 10), 6).alias("rate"))


@query(f"with h as ({HITS}), l as (select event_id, {S.level('rate')} as level from h) select event_id, level, {S.pick(('brak', 'słaby', 'umiarkowany', 'silny', 'ulewny'), 'level')} as label from l")
def classify_rate(s: Scene) -> DataFrame:
    rows = s.hits().select("event_id", classify.level_of_rate(F.col("rate")).alias("level"))
    return rows.select("event_id", "level", classify.level_name(F.col("level")).alias("label"))


@query(f"""with h as (select event_id, floor(value) / 500e0 as rate from events) select event_id, case when rate > 0 and rate < 0.1e0 then 1 else {S.level('rate')} end as class from h""")
def overlay_classes(s: Scene) -> DataFrame:
    """Classes as the overlay paints them: drizzle under the first class counts as the first."""
    rate = F.col("rate")
    return s.table("events").select("event_id", (F.floor("value") / 500.0).alias("rate")).select("event_id", F.when((rate > 0) & (rate < 0.1), 1).otherwise(classify.level_of_rate(rate)).alias("class"))


# Colour of each overlay class.
OVERLAY = ((0x36BAE5, 1), (0x005B8E, 2), (0xE8B400, 3), (0xE62800, 4))


@query(f"""with c(rgb, class) as (values {', '.join(f'({a}, {b})' for a, b in OVERLAY)}), p as (select p_partkey, case p_size % 5 when 0 then 1 {' '.join(f'when {b} then {a}' for a, b in OVERLAY)} end as rgb, case when p_partkey % 7 = 0 then 0 else 255 end as a from part)
select p_partkey, case when a > 0 then coalesce(class, 0) else 0 end as class from p left join c using (rgb)""")
def overlay_rgba_class(s: Scene) -> DataFrame:
    """The class that a pixel of the overlay shows."""
    at = F.col("p_size") % 5
    rgb = F.lit(1)
    for colour, n in OVERLAY:
        rgb = F.when(at == n, colour).otherwise(rgb)
    classes = F.create_map(*[F.lit(x) for row in OVERLAY for x in row])
    shown = F.when(F.col("a") > 0, F.coalesce(classes[F.col("rgb")], F.lit(0))).otherwise(0)
    return s.table("part").select("p_partkey", rgb.alias("rgb"), F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(255).alias("a")).select("p_partkey", shown.alias("class"))


@query(f"select event_id, {S.half_up('event_id % 50 / 111e0', 9)} as d_lat, {S.half_up('event_id % 50 / (111e0 * greatest(cos(radians(event_id % 90)), 0.25e0))', 9)} as d_lon from events")
def geo_degrees(s: Scene) -> DataFrame:
    """Kilometres as degrees, at latitudes from 0 to 89."""
    k = F.col("event_id")
    return s.table("events").select("event_id", geo.half_up(geo.lat_degrees(k % 50), 9).alias("d_lat"), geo.half_up(geo.lon_degrees(k % 50, (k % 90).cast("double")), 9).alias("d_lon"))


@query("select event_id, least(abs(event_id % 720 - user_id % 360) % 360, 360 - abs(event_id % 720 - user_id % 360) % 360) as apart from events")
def angle_difference(s: Scene) -> DataFrame:
    return s.table("events").select("event_id", geo.angle_between(F.col("event_id") % 720, F.col("user_id") % 360).alias("apart"))


@query("select event_id, case when event_id % 40 > 3 then 45e0 * ((event_id % 40 - 3) * 100) / 1800e0 else 0e0 end as gate from events")
def gate_km(s: Scene) -> DataFrame:
    """A gate of 45 km for half an hour at other times; none without time."""
    from pluvio.functions.const import MATCH_KM
    from pluvio.operators.trails import gate

    return s.table("events").select("event_id", gate(MATCH_KM, (F.col("event_id") % 40 - 3) * 100).alias("gate"))


@query("select event_id, case when event_id % 3 > 0 then floor(value * 10 + 0.5) / 100e0 else case event_id % 5 when 0 then 0 when 1 then 0.1e0 when 2 then 1 when 3 then 4 else 10 end end as rate from events")
def sample_rate(s: Scene) -> DataFrame:
    """The rate of a sample, or the least of its class where it has none."""
    rate = F.when(F.col("event_id") % 3 > 0, F.floor(F.col("value") * 10 + 0.5) / 100.0)
    return s.table("events").select("event_id", classify.rate_of_sample(rate, F.col("event_id") % 5).alias("rate"))
