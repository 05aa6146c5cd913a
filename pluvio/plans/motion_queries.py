"""Correlation of frames, motion fields, timelines, and the whole threat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo
from pluvio.operators import advect as A
from pluvio.operators import growth as G
from pluvio.operators import motion as N
from pluvio.operators import pins as P
from pluvio.operators import threat as TH
from pluvio.operators import trails as T
from pluvio.operators import verify as V
from pluvio.operators import warnings as W
from pluvio.operators.stages import written
from pluvio.plans import mass_queries as MQ
from pluvio.plans import sqltext as S
from pluvio.plans.fixtures import PINS, Scene
from pluvio.plans.grid_queries import samples, samples_sql
from pluvio.plans.mass_queries import kept, near, near_sql
from pluvio.plans.registry import query

PIN_SQL = PINS.format(nation="nation")
LAT, LON = 51.5, 19.2
_X = f"cast(floor((lon - {LON}e0) / (3 / (111 * greatest(cos(radians({LAT}e0)), 0.25e0))) + 0.5) + 20 as int)"
_Y = f"cast(floor((lat - {LAT}e0) / (3 / 111e0) + 0.5) + 20 as int)"
GRID = f"""with {samples_sql(peaked=True)}, c as (select frame_time, lat, lon, level, {_X} as ix, {_Y} as iy from samples where level >= 1), grid as materialized (select frame_time, ix, iy, cast(max(level) as double) as v from c where ix between 0 and 39 and iy between 0 and 39 group by all)"""
SMOOTH = f"""{GRID}, off as (select unnest(range(-3, 4)) as d), sm as materialized (select frame_time, ix, iy, v / ((least(39, ix + 3) - greatest(0, ix - 3) + 1) * (least(39, iy + 3) - greatest(0, iy - 3) + 1)) as v from (select frame_time, cast(ix + a.d as int) as ix, cast(iy + b.d as int) as iy, sum(v) as v from grid, off a, off b where ix + a.d between 0 and 39 and iy + b.d between 0 and 39 group by all) q)"""


def _shifted(shifts: str) -> str:
    """The reference form: all 1,600 cells of both frames, whether wet or not."""
    return f"""{SMOOTH}, ft as (select distinct frame_time from samples), times as (select * from (select frame_time, lag(frame_time) over (order by frame_time) as prev_time from ft) q where prev_time is not null),
xy as (select cast(x as int) as ix, cast(y as int) as iy from range(40) a(x), range(40) b(y)), full_ as materialized (select ft.frame_time, xy.ix, xy.iy, coalesce(v, 0) as v from ft cross join xy left join sm on sm.frame_time = ft.frame_time and sm.ix = xy.ix and sm.iy = xy.iy),
sh as ({shifts}), j as (select prev_time, t.frame_time, dx, dy, a.v as a, b.v as b from times t cross join sh join full_ a on a.frame_time = prev_time join full_ b on b.frame_time = t.frame_time and b.ix = a.ix + dx and b.iy = a.iy + dy where a.v > 0 or b.v > 0),
r as (select prev_time, frame_time, dx, dy, case when count(*) < 10 or sum(a * a) - sum(a) * sum(a) / count(*) <= 1e-6 or sum(b * b) - sum(b) * sum(b) / count(*) <= 1e-6 then -1 else corr(a, b) * (40 - abs(dx)) * (40 - abs(dy)) / 1600e0 end as score from j group by prev_time, frame_time, dx, dy)"""


def _grid(s: Scene) -> DataFrame:
    return N.cells(samples(s, peaked=True), LAT, LON)


def _times(s: Scene) -> DataFrame:
    return T.frame_pairs(samples(s, peaked=True)).select("frame_time", "prev_time")


@query(f"with {samples_sql(peaked=True)} select frame_time, lat, lon, {_X} as ix, {_Y} as iy from samples")
def ncc_cell(s: Scene) -> DataFrame:
    """The correlation cell of every sample, on the grid or off it."""
    x, y = A.cell_of(F.col("lat"), F.col("lon"), F.lit(LAT), F.lit(LON))
    return samples(s, peaked=True).select("frame_time", "lat", "lon", x.cast("int").alias("ix"), y.cast("int").alias("iy"))


@query(f"{GRID} select * from grid")
def ncc_grid(s: Scene) -> DataFrame:
    return _grid(s)


@query(f"{SMOOTH} select frame_time, ix, iy, {near_sql('v', 6)} as v from sm")
def box_smooth(s: Scene) -> DataFrame:
    return N.smooth(_grid(s)).withColumn("v", near(F.col("v"), 6))


_EVERY = 10
_ALL = f"select cast(x as int) as dx, cast(y as int) as dy from range(-{_EVERY}, {_EVERY + 1}) a(x), range(-{_EVERY}, {_EVERY + 1}) b(y)"


def _scores(s: Scene) -> DataFrame:
    """Of two frames 5 minutes apart no echo comes farther than 8 km, three cells of 3 km; ten leave no shift in doubt."""
    return N.correlations(N.smooth(_grid(s)), _times(s), _EVERY)


@query(f"{_shifted(_ALL)} select frame_time, dx, dy, {near_sql('score', 6)} as score from r")
def ncc_shift(s: Scene) -> DataFrame:
    """The score of each of the 441 shifts of up to ten cells either way."""
    return _scores(s).select("frame_time", "dx", "dy", near(F.col("score"), 6).alias("score"))


@query(f"{_shifted(_ALL)} select frame_time, dx, dy, {near_sql('score', 5)} as score from (select *, row_number() over (partition by frame_time order by {near_sql('score', 9)} desc, dy, dx) as rn from r where score >= 0.4e0) q where rn = 1")
def best_ncc(s: Scene) -> DataFrame:
    """The best of these shifts, all of them looked at."""
    best = P.first_by(_scores(s).where("score >= 0.4"), ["frame_time"], near(F.col("score"), 9).desc(), F.col("dy"), F.col("dx"))
    return best.select("frame_time", "dx", "dy", near(F.col("score"), 5).alias("score"))


_NEAR = "select cast(x as int) as dx, cast(y as int) as dy from range(-3, 4) a(x), range(-3, 4) b(y)"


@query(f"{_shifted(_NEAR)} select frame_time, dx, dy, {near_sql('score', 6)} as score from r")
def ncc_shift_all(s: Scene) -> DataFrame:
    """The score of each of the 49 shifts of up to three cells either way."""
    scores = N.correlations(N.smooth(_grid(s)), _times(s), 3)
    return scores.select("frame_time", "dx", "dy", near(F.col("score"), 6).alias("score"))


def _between(low: str, high: str) -> str:
    """Where the parabola through the best score and its neighbours is highest."""
    bend = f"({low} - 2 * score + {high})"
    return f"(case when least({low}, {high}) < 0.4e0 or {bend} >= 0 then 0 else greatest(-0.5e0, least(0.5e0, 0.5e0 * ({low} - {high}) / {bend})) end)"


_FOUR = "select cast(x as int) as dx, cast(y as int) as dy from range(-4, 5) a(x), range(-4, 5) b(y)"
_MOVED = S.km(f"{LAT}e0", f"{LON}e0", "to_lat", "to_lon")
_WAYS = S.turn(f"{LAT}e0", f"{LON}e0", "to_lat", "to_lon")
#: In five minutes no echo comes farther than three cells. The pair counts twice, as neighbours and as ends.
_PAIR = f"""{_shifted(_FOUR)}, wet as (select frame_time from grid where v > 0 group by frame_time having count(*) >= 4), ok as (select * from r where prev_time in (select frame_time from wet) and frame_time in (select frame_time from wet)),
best as (select * from (select *, row_number() over (partition by frame_time order by {near_sql('score', 9)} desc, dy, dx) as rn from ok where score >= 0.4e0 and abs(dx) <= 3 and abs(dy) <= 3) q where rn = 1 and (dx <> 0 or dy <> 0)),
n as (select b.*, w.score as sw, e.score as se, s.score as ss, o.score as sn from best b join r w on w.frame_time = b.frame_time and w.dx = b.dx - 1 and w.dy = b.dy join r e on e.frame_time = b.frame_time and e.dx = b.dx + 1 and e.dy = b.dy
 join r s on s.frame_time = b.frame_time and s.dx = b.dx and s.dy = b.dy - 1 join r o on o.frame_time = b.frame_time and o.dx = b.dx and o.dy = b.dy + 1),
m as (select frame_time as pair, prev_time, score, {LAT}e0 + (dy + {_between('ss', 'sn')}) * 3 / 111e0 as to_lat, {LON}e0 + (dx + {_between('sw', 'se')}) * 3 / (111 * greatest(cos(radians({LAT}e0)), 0.25e0)) as to_lon from n)
select * from (select pair, {near_sql(f'{_MOVED} / ((pair - prev_time) / 3600e0)', 5)} as speed, {near_sql(_WAYS, 5)} as bearing, cast(floor(least(95e0, 40 + 40 * score + 16 + 5) + 0.5e0) as int) as confidence from m) q where speed between 1 and 95"""


@query(_PAIR)
def pair_motion(s: Scene) -> DataFrame:
    """Motion between each two consecutive frames around one point, by the array kernel."""
    rows = samples(s, peaked=True).select("frame_time", "lat", "lon", "level", F.lit(LAT).alias("c_lat"), F.lit(LON).alias("c_lon"))
    times = _times(s)
    later = rows.join(times, "frame_time").withColumn("pair", F.col("frame_time")).drop("prev_time")
    earlier = rows.join(times.select(F.col("prev_time").alias("frame_time"), F.col("frame_time").alias("pair")), "frame_time")
    found = N.motions(later.unionByName(earlier), ["pair"])
    return found.select("pair", near(F.col("speed"), 5).alias("speed"), near(F.col("bearing"), 5).alias("bearing"), "confidence")


def _echo(s: Scene) -> TH.Echo:
    """The scene as one scan of seven frames; its cells are fine enough for motion on cells of 2 km. The samples are those that the masses are of."""
    def make() -> TH.Echo:
        rows = MQ._samples(s).drop("sample_id").withColumn("ncc_cell_km", F.when(F.col("cell_km") <= 3, 2.0))
        scans = written(T.one_scan(rows))
        return TH.Echo(rows, scans, written(T.ends_of(scans, rows)), MQ._members(s), MQ._summary(s), MQ._matched(s), MQ._trails(s))

    return kept(s, "echo", make)


@query()
def system_motion(s: Scene) -> DataFrame:
    """Motion of all echo around each pin."""
    return TH.regional_motion(_echo(s), s.pins()).drop("scan_time")


@query()
def mass_motion(s: Scene) -> DataFrame:
    """Motion and confidence of the newest frame's masses."""
    return TH.mass_motion(_echo(s)).select("trail_id", "speed", "bearing", "confidence")


@query(f"with {samples_sql(peaked=True)} select max(cell_km) as cell_km, coalesce(max(case when cell_km <= 3 then 2e0 end), max(cell_km)) as motion_km from samples")
def motion_cell(s: Scene) -> DataFrame:
    """The size of cells of a scan, and of its motion grid."""
    return TH.cell_km(_echo(s)).select("cell_km", "motion_km")


ANCHORS = f"a as (select pin_id as k, lat, lon, (20e0 + 10 * pin_id) * sin(radians(40e0 * pin_id)) as u, (20e0 + 10 * pin_id) * cos(radians(40e0 * pin_id)) as v from ({PIN_SQL}) q)"


def _anchors(s: Scene) -> DataFrame:
    """The anchors of the scan, one at every pin; it is frame 0."""
    k = F.col("pin_id")
    u, v = geo.to_uv(40.0 * k, 20.0 + 10 * k)
    return s.pins().select(F.lit(0).alias("frame_time"), "lat", "lon", u.alias("u"), v.alias("v"))


def _beside(s: Scene) -> DataFrame:
    """A place beside each pin."""
    return s.pins().select(F.lit(0).alias("frame_time"), "pin_id", (F.col("lat") + 0.2).alias("pin_lat"), (F.col("lon") + 0.2).alias("pin_lon"))


def _idw(point: str, lat: str, lon: str, x: str = "x") -> str:
    """Means of the anchors within 80 km, which lie in the cell of a point, 1 by 1.5 degrees, or beside it."""
    d = S.km(lat, lon, "a.lat", "a.lon")
    beside = "(select a.*, cast(floor(lat) as int) + i.d as cy, cast(floor(lon / 1.5e0) as int) + j.d as cx from a, (values (-1), (0), (1)) i(d), (values (-1), (0), (1)) j(d))"
    return f"select {point}, sum(u / ({d} * {d} + 1)) / sum(1 / ({d} * {d} + 1)) as u, sum(v / ({d} * {d} + 1)) / sum(1 / ({d} * {d} + 1)) as v from {x} join {beside} a on a.cy = cast(floor({lat}) as int) and a.cx = cast(floor({lon} / 1.5e0) as int) where {d} <= 80 group by {point}"


@query(f"with {ANCHORS}, x as (select pin_id, lat + 0.2e0 as plat, lon + 0.2e0 as plon from ({PIN_SQL}) p), m as ({_idw('pin_id', 'x.plat', 'x.plon')}) select pin_id, {near_sql('u', 6)} as u, {near_sql('v', 6)} as v from x left join m using (pin_id)")
def idw_motion(s: Scene) -> DataFrame:
    rows = A.interpolated(_beside(s), _anchors(s), ("pin_lat", "pin_lon"))
    return rows.select("pin_id", near(F.col("u"), 6).alias("u"), near(F.col("v"), 6).alias("v"))


_FIELD = f"""with {ANCHORS}, x as (select pin_id, cast(i as int) as ix, cast(j as int) as iy, lat + 0.2e0 + (j - 20) * (3 / 111e0) as plat, lon + 0.2e0 + (i - 20) * (3 / (111 * greatest(cos(radians(lat + 0.2e0)), 0.25e0))) as plon from ({PIN_SQL}) p, range(40) r(i), range(40) q(j)),
m as ({_idw('pin_id, ix, iy', 'x.plat', 'x.plon')}) select pin_id, ix, iy, {near_sql('coalesce(u, 5)', 5)} as u, {near_sql('coalesce(v, 7)', 5)} as v from x left join m using (pin_id, ix, iy)"""


@query(_FIELD)
def motion_field(s: Scene) -> DataFrame:
    """All 1,600 cells of the field around every pin; (5, 7) in the background."""
    rows = _beside(s).withColumn("background", F.struct(F.lit(5.0).alias("u"), F.lit(7.0).alias("v")))
    cells = F.sequence(F.lit(0), F.lit(39))
    rows = rows.withColumn("ix", F.explode(cells)).withColumn("iy", F.explode(cells))
    lat, lon = F.col("pin_lat") + (F.col("iy") - 20) * geo.lat_degrees(3.0), F.col("pin_lon") + (F.col("ix") - 20) * geo.lon_degrees(3.0, "pin_lat")
    return A.with_motion(A.with_anchors(rows, _anchors(s)), lat, lon).select("pin_id", "ix", "iy", near(F.col("m.u"), 5).alias("u"), near(F.col("m.v"), 5).alias("v"))


@query(_FIELD)
def motion_field_whole(s: Scene) -> DataFrame:
    """The same under the name it had while motion_field was a part of it."""
    return motion_field(s)


#: One motion for all: 40 km/h toward 70 degrees.
_BACK = S.dest("p.lat", "p.lon", "250e0", "(40e0 * t / 60e0)")


def _uniform(s: Scene) -> DataFrame:
    u, v = geo.to_uv(F.lit(70.0), F.lit(40.0))
    return s.pins().select("pin_id", F.col("lat").alias("pin_lat"), F.col("lon").alias("pin_lon"), F.struct(u.alias("u"), v.alias("v")).alias("background"), F.lit(True).alias("moving"))


@query(f"with p as ({PIN_SQL}), t as (select cast(unnest(range(0, 91, 5)) as int) as t) select pin_id, t, {S.half_up(_BACK[0], 5)} as lat, {S.half_up(_BACK[1], 5)} as lon from p, t")
def back_trajectory(s: Scene) -> DataFrame:
    rows = _uniform(s).withColumns({"frame_time": F.lit(0), "t": F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(5)))})
    return A.departures(rows).select("pin_id", "t", geo.half_up(F.col("at_lat"), 5).alias("lat"), geo.half_up(F.col("at_lon"), 5).alias("lon"))


_FWD = S.dest("s.lat", "s.lon", "70e0", "(40e0 * t / 60e0)")
_CB = S.project("at_lat", "at_lon")
TIMELINE = f"""with {samples_sql()}, p as ({PIN_SQL}), g as ({S.georef()}), t as (select cast(unnest(range(0, 91, 5)) as int) as t), last as (select * from samples where frame_time = (select max(frame_time) from samples)),
dep as (select pin_id, p.lat, p.lon, t, case when t = 0 then p.lat else {_BACK[0]} end as at_lat, case when t = 0 then p.lon else {_BACK[1]} end as at_lon from p, t),
re as (select dep.*, 6 + least(0.15e0 * (case when t = 0 then 0 else {S.km('lat', 'lon', 'at_lat', 'at_lon')} end), 6) as reach, ({_CB[0]} - gl) / gw as cc, (gt - {_CB[1]}) / gh as rr from dep, g),
arr as (select pin_id, t, avg(s.rate) as r from re join last s on {S.km('s.lat', 's.lon', 're.lat', 're.lon')} <= 108 and (case when t = 0 then {S.km('s.lat', 's.lon', 're.at_lat', 're.at_lon')} else {S.km(_FWD[0], _FWD[1], 're.lat', 're.lon')} end) <= reach group by all),
tl as (select pin_id, t, coalesce(r, 0) as r, (r is null or t = 0) and not (cc >= 0 and cc < 800 and rr >= 0 and rr < 800) as unknown from re left join arr using (pin_id, t)),
timeline as (select pin_id, t, case when unknown then 0 else {S.level('r')} end as level, case when unknown then 0 else {S.half_up('r', 1)} end as rate, unknown from tl)"""


def _timeline(s: Scene) -> DataFrame:
    last = written(P.newest(samples(s)))
    pins = _uniform(s).crossJoin(F.broadcast(last.agg(F.max("frame_time").alias("frame_time"))))  # one row
    return A.timeline(last, pins).drop("frame_time")


@query(f"{TIMELINE} select * from timeline")
def pin_timeline(s: Scene) -> DataFrame:
    return _timeline(s)


@query(f"{TIMELINE} select pin_id, max(level) as max_level, min(t) filter (t > 0 and not unknown and level >= 1) as first_wet, bool_or(unknown) as left_coverage from timeline group by pin_id")
def timeline_reduce(s: Scene) -> DataFrame:
    return _reduced(_timeline(s))


def _reduced(timeline: DataFrame) -> DataFrame:
    wet = (F.col("t") > 0) & ~F.col("unknown") & (F.col("level") >= 1)
    return timeline.groupBy("pin_id").agg(F.max("level").alias("max_level"), F.min(F.when(wet, F.col("t"))).alias("first_wet"), F.bool_or("unknown").alias("left_coverage"))


# A field of anchors on the scan's cells.


def _carried(lat: str, lon: str, t: str, back: int) -> tuple[str, str]:
    """A place moved by (mu, mv), or against it."""
    return S.dest(lat, lon, f"((degrees(atan2(mu, mv)) + {360 + back}e0) % 360e0)", f"(sqrt(mu * mu + mv * mv) * {t} / 60e0)")


def _in_field(name: str, source: str, keys: str, lat: str, lon: str, km: float) -> str:
    """CTE ``name``: the rows of ``source`` with mu, mv, the motion of their place on the grid of ``km`` around the pin (lat, lon); (5, 7) where no anchor is near."""
    wide = f"({km}e0 / (111 * greatest(cos(radians(lat)), 0.25e0)))"
    return f"""{name}_c as (select *, floor(({lon} - lon) / {wide} + 0.5e0) + 20 as gx, floor(({lat} - lat) / ({km} / 111e0) + 0.5e0) + 20 as gy from {source}),
{name}_m as (select *, case when gx between 0 and 39 and gy between 0 and 39 then lat + (gy - 20) * ({km} / 111e0) else {lat} end as plat, case when gx between 0 and 39 and gy between 0 and 39 then lon + (gx - 20) * {wide} else {lon} end as plon from {name}_c),
{name}_i as ({_idw(keys, 'x.plat', 'x.plon', f'{name}_m x')}),
{name} as materialized (select {name}_m.*, coalesce(u, 5) as mu, coalesce(v, 7) as mv from {name}_m left join {name}_i using ({keys}))"""


_TURN = _carried("lat", "lon", "t", 180)
_GONE = _carried("s_lat", "s_lon", "t", 0)


def _field_timeline_sql(km: float) -> str:
    steps, held = [], "dep0"
    for k in range(3):
        steps.append(_in_field(f"f{k}", held, "pin_id, t", "at_lat", "at_lon", km))
        steps.append(f"dep{k + 1} as (select pin_id, lat, lon, t, case when t = 0 then lat else {_TURN[0]} end as at_lat, case when t = 0 then lon else {_TURN[1]} end as at_lon from f{k})")
        held = f"dep{k + 1}"
    return f"""with {samples_sql()}, {ANCHORS}, p as ({PIN_SQL}), g as ({S.georef()}), t as (select cast(unnest(range(0, 91, 5)) as int) as t), last as (select *, row_number() over (order by lat, lon) as sid from samples where frame_time = (select max(frame_time) from samples)),
dep0 as (select pin_id, p.lat, p.lon, t, p.lat as at_lat, p.lon as at_lon from p, t), {", ".join(steps)},
re as (select dep3.*, 6 + least(0.15e0 * (case when t = 0 then 0 else {S.km('lat', 'lon', 'at_lat', 'at_lon')} end), 6) as reach, ({_CB[0]} - gl) / gw as cc, (gt - {_CB[1]}) / gh as rr from dep3, g),
near as (select pin_id, p.lat, p.lon, sid, s.lat as s_lat, s.lon as s_lon, s.rate from p join last s on {S.km('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 108), {_in_field('sm', 'near', 'pin_id, sid', 's_lat', 's_lon', km)},
gone as (select sm.pin_id, t.t, sm.rate, sm.lat, sm.lon, case when t = 0 then s_lat else {_GONE[0]} end as g_lat, case when t = 0 then s_lon else {_GONE[1]} end as g_lon from sm, t),
arr as (select re.pin_id, re.t, avg(gone.rate) as r from gone join re using (pin_id, t) where {S.km('g_lat', 'g_lon', 're.lat', 're.lon')} <= reach group by re.pin_id, re.t),
tl as (select pin_id, t, coalesce(r, 0) as r, (r is null or t = 0) and not (cc >= 0 and cc < 800 and rr >= 0 and rr < 800) as unknown from re left join arr using (pin_id, t))
select pin_id, t, case when unknown then 0 else {S.level('r')} end as level, case when unknown then 0 else {S.half_up('r', 1)} end as rate, unknown from tl"""


def _field_timeline(s: Scene, km: float) -> DataFrame:
    """Timelines through the field of an anchor at every pin, on cells of ``km``."""
    last = written(P.newest(samples(s)))
    frame = last.agg(F.max("frame_time").alias("frame_time"))  # one row
    background = F.struct(F.lit(5.0).alias("u"), F.lit(7.0).alias("v"))
    pins = _uniform(s).withColumns({"background": background, "field_km": F.lit(km)}).crossJoin(F.broadcast(frame))
    anchors = _anchors(s).drop("frame_time").crossJoin(F.broadcast(frame))
    return A.timeline(last, pins, anchors).drop("frame_time")


@query(_field_timeline_sql(6.0))
def pin_timeline_field(s: Scene) -> DataFrame:
    """Through a field on cells of 6 km, those of a scan that was coarsened once."""
    return _field_timeline(s, 6.0)


@query(_field_timeline_sql(3.0))
def pin_timeline_field_fine(s: Scene) -> DataFrame:
    """Through the same field on cells of 3 km."""
    return _field_timeline(s, 3.0)


_SLOPE = "((pin_id % 5 - 2) / 50e0)"
_GROW = f"(case when t <= 0 then 0 when t <= 18 then {_SLOPE} * t else {_SLOPE} * 18 * exp(-(t - 18) / 30e0) end)"
_GREW = f"greatest(0, {S.half_up(f'rate + {_GROW}', 1)})"


@query(f"{TIMELINE} select pin_id, t, case when unknown or rate <= 0 or {_GROW} = 0 then level else {S.level(_GREW)} end as level, case when unknown or rate <= 0 or {_GROW} = 0 then rate else {_GREW} end as rate from timeline")
def growth_timeline(s: Scene) -> DataFrame:
    """Timelines with a trend of -0.04 to 0.04 mm/h a minute, by pin, which fades after 18 minutes; off in the threat unless asked for."""
    return G.grown(_timeline(s), (F.col("pin_id") % 5 - 2) / 50.0).select("pin_id", "t", "level", "rate")


def _places(s: Scene) -> DataFrame:
    """Pins with the code of their county, as the warnings name it."""
    return s.pins().withColumn("terc", F.lpad((F.col("pin_id") + 200).cast("string"), 4, "0"))


def _official(s: Scene, now: DataFrame) -> DataFrame:
    """The warnings, moved to the time of the scan, a day apart at most."""
    rows = s.warnings().crossJoin(F.broadcast(now)).withColumn("starts", F.timestamp_seconds(F.col("now") + (F.col("id") % 48 - 24) * 3600))
    return rows.select("id", "degree", "starts", (F.col("starts") + F.expr("interval 8 hours")).alias("ends"), W.storm_related(F.col("event")).alias("storm"), F.array("code_a", "code_b").alias("teryt"), F.concat(F.lit("IMGW: "), F.col("event"), F.lit(".")).alias("body"))


@query()
def threat(s: Scene) -> DataFrame:
    """What each pin has to expect of the newest scan, with warnings and lightning; its timeline as JSON."""
    e = _echo(s)
    now = e.ends.select(F.col("scan_time").alias("now"))  # one row
    strikes = s.strikes().crossJoin(F.broadcast(now.withColumnRenamed("now", "scan_time")))
    found = TH.threats(e, _places(s), _official(s, now), strikes)
    return found.withColumn("timeline", F.to_json("timeline")).drop("now_lat", "now_lon")


@query()
def threat_tracks(s: Scene) -> DataFrame:
    """The arrows of the newest scan."""
    return TH.tracks(TH.moving_masses(_echo(s))).drop("scan_time")


def _hindcast(s: Scene) -> V.Hindcast:
    """24 frames, scored from the fourth on as long as an hour follows; every scan is four frames."""
    rows = written(samples(s, frames=24, peaked=True).withColumn("ncc_cell_km", F.when(F.col("cell_km") <= 3, 2.0)))
    scored = V.scored_frames(rows)
    scans = T.rolling_scans(rows).join(scored.withColumnRenamed("frame_time", "scan_time"), "scan_time", "left_semi")
    found = written(TH.threats(TH.echo(rows, scans), s.pins()))
    return V.hindcast(found, written(V.observed_at_leads(rows, s.pins())))


@query()
def hindcast_skill(s: Scene) -> DataFrame:
    """Nowcast, persistence, alerts, chances and motion held against what came."""
    return V.long_form(_hindcast(s))


@query()
def hindcast_report(s: Scene) -> DataFrame:
    """The same as lines of text."""
    return V.report(_hindcast(s))
