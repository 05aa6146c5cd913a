"""Joins by distance, masses and their trails."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo
from pluvio.functions.const import PIN_KM, TRACK_KM
from pluvio.operators import masses as M
from pluvio.operators import pins as P
from pluvio.operators import threat as TH
from pluvio.operators import trails as T
from pluvio.operators.spatial import range_join
from pluvio.operators.stages import written
from pluvio.plans import sqltext as S
from pluvio.plans.fixtures import MOVES, PINS, STRIKES, Scene
from pluvio.plans.grid_queries import samples, samples_sql
from pluvio.plans.registry import query

PIN_SQL = PINS.format(nation="nation")
_AB = S.km("a.lat", "a.lon", "b.lat", "b.lon")
NUM = f"{samples_sql(peaked=True)}, num as materialized (select *, row_number() over (partition by frame_time order by level desc, lat, lon) as sample_id from samples)"
LINKS = f"{NUM}, links as materialized (select a.frame_time, a.sample_id as a, b.sample_id as b, {_AB} as km from num a join num b on a.frame_time = b.frame_time and a.sample_id < b.sample_id and {_AB} <= 6.5e0)"
CORES = f"cores as materialized (select a.* from num a where level >= 3 and not exists (select 1 from num b where a.frame_time = b.frame_time and a.sample_id <> b.sample_id and b.level >= a.level and {_AB} <= 6.5e0))"
COMP = f"""with recursive {LINKS}, sym as materialized (select frame_time, a, b from links union all select frame_time, b, a from links),
walk as (select frame_time, sample_id, sample_id as label from num union select w.frame_time, e.b, w.label from walk w join sym e on w.frame_time = e.frame_time and w.sample_id = e.a where w.label < e.b),
comp as materialized (select frame_time, sample_id, min(label) as component from walk group by all)"""
MASS = f"""{COMP}, {CORES}, found as (select n.*, c.component, count(*) over (partition by n.frame_time, component) as size from num n join comp c using (frame_time, sample_id)),
kept as (select * from found where size >= 3), cc as (select k.frame_time, k.component, k.sample_id as core, k.lat, k.lon, count(*) over (partition by k.frame_time, k.component) as cores from kept k join cores c using (frame_time, sample_id)),
near as (select a.frame_time, a.sample_id, b.core, row_number() over (partition by a.frame_time, a.sample_id order by {_AB}, b.core) as rn from kept a join cc b on a.frame_time = b.frame_time and a.component = b.component where cores >= 2),
dealt as (select k.*, core, count(*) over (partition by k.frame_time, component, core) as part from kept k left join near n on n.frame_time = k.frame_time and n.sample_id = k.sample_id and rn = 1),
best as (select *, max(case when core is not null then part end) over (partition by frame_time, component) as most from dealt),
members as materialized (select frame_time, sample_id, lat, lon, level, rate, mass_id from (select *, case when coalesce(most, 0) >= 12 then case when part >= 12 then core end when size >= 12 then component end as mass_id from best) q where mass_id is not null),
summ as materialized (select frame_time, mass_id, sum(lat * level) / sum(level) as lat, sum(lon * level) / sum(level) as lon, count(*) as n, max(level) as max_level, avg(level) as mean_level from members group by all)"""
TIMES = "times as (select * from (select frame_time, lag(frame_time) over (order by frame_time) as prev_time, frame_time - lag(frame_time) over (order by frame_time) as dt from (select distinct frame_time from samples) f) q where prev_time is not null)"
OVER = f"{MASS}, {TIMES}, over_ as materialized (select a.frame_time, t.prev_time, a.mass_id, b.mass_id as prev_id, count(distinct a.sample_id) as hits from members a join times t using (frame_time) join members b on b.frame_time = t.prev_time and {_AB} <= 6.5e0 group by all)"
MATCH = f"""{OVER}, pairs as (select a.frame_time, a.mass_id, t.prev_time, b.mass_id as prev_id, {_AB} as d, t.dt, 45e0 * t.dt / 1800e0 as gate, b.max_level as pl from summ a join times t using (frame_time) join summ b on b.frame_time = t.prev_time),
matched as materialized (select * from (select p.*, coalesce(hits, 0) * 10 + (gate - d) as score, row_number() over (partition by p.frame_time, p.mass_id order by coalesce(hits, 0) * 10 + (gate - d) desc, pl desc, p.prev_id) as rn from pairs p left join over_ o using (frame_time, prev_time, mass_id, prev_id) where d <= gate) q where rn = 1)"""
TRAIL = f"""{MATCH}, trail0 as (select frame_time, mass_id, mass_id as trail_id, 0 as hop from summ where frame_time = (select max(frame_time) from summ)
 union all select m.prev_time, m.prev_id, t.trail_id, t.hop + 1 from trail0 t join matched m on m.frame_time = t.frame_time and m.mass_id = t.mass_id where m.d / (m.dt / 3600e0) <= 95 and t.hop < 6),
trail as materialized (select t.trail_id, s.* from trail0 t join summ s using (frame_time, mass_id))"""
_E = S.km("a_lat", "a_lon", "z_lat", "z_lon")
_H = S.km("p_lat", "p_lon", "lat", "lon")
_W = "(case when abs(turn - deg_all) % 360 > 180 then 360 - abs(turn - deg_all) % 360 else abs(turn - deg_all) % 360 end)"
MOTION = f"""{TRAIL}, tw as (select trail_id, frame_time, lat, lon, count(*) over w as n, first_value(lat) over w as a_lat, first_value(lon) over w as a_lon, first_value(frame_time) over w as a_t, last_value(lat) over w as z_lat, last_value(lon) over w as z_lon, last_value(frame_time) over w as z_t,
 lag(lat) over o as p_lat, lag(lon) over o as p_lon, lag(frame_time) over o as p_t from trail window w as (partition by trail_id order by frame_time rows between unbounded preceding and unbounded following), o as (partition by trail_id order by frame_time)),
te as (select *, {_E} as moved, (z_t - a_t) / 3600e0 as hours, {S.turn('a_lat', 'a_lon', 'z_lat', 'z_lon')} as deg_all, {_H} as step, {S.turn('p_lat', 'p_lon', 'lat', 'lon')} as turn from tw),
parts as (select trail_id, turn as deg, greatest(step, 0.5e0) as w from te where p_t is not null and step / ((frame_time - p_t) / 3600e0) <= 95 and not (n >= 3 and moved > 8 and {_W} > 70)
 union all select trail_id, deg_all, greatest(moved, 1e0) * case when n >= 3 then 2 else 1 end from te where p_t is null and n >= 2),
turns as (select trail_id, (degrees(atan2(sum(w * sin(radians(deg))), sum(w * cos(radians(deg))))) + 360e0) % 360e0 as bearing from parts group by trail_id),
motion as materialized (select te.trail_id, n, moved, hours, moved / hours as speed, bearing, a_lat as from_lat, a_lon as from_lon from te join turns using (trail_id) where p_t is null and n >= 2 and moved / hours <= 95)"""


def kept(s: Scene, name: str, make: Callable[[], Any]) -> Any:
    """A stage that a query makes once, however often it reads it."""
    if name not in s.stages:
        s.stages[name] = make()
    return s.stages[name]


def _samples(s: Scene) -> DataFrame:
    return kept(s, "samples", lambda: written(M.numbered(samples(s, peaked=True))))


def _members(s: Scene) -> DataFrame:
    return kept(s, "members", lambda: written(M.masses(_samples(s))))


def near(x: F.Column, digits: int) -> F.Column:
    """Rounded off the halves, on which sums of different order may fall either way."""
    return F.floor(x * 10.0**digits + 0.50013) / 10.0**digits


def _r(*names: str, digits: int = 6) -> list:
    return [near(F.col(n), digits).alias(n) for n in names]


def near_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.50013e0) / 1e{digits}"


def _rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{near_sql(n, digits)} as {n}" for n in names)


@query(f"with {LINKS} select frame_time, a, b, {S.half_up('km', 6)} as km from links")
def link_pairs(s: Scene) -> DataFrame:
    return M.link_pairs(_samples(s)).select("frame_time", "a", "b", geo.half_up(F.col("km"), 6).alias("km"))


@query(f"with p as ({PIN_SQL}), k as ({STRIKES.format(events='events')}) select pin_id, strike_id, {S.half_up(S.km('p.lat', 'p.lon', 'k.lat', 'k.lon'), 5)} as km from p join k on {S.km('p.lat', 'p.lon', 'k.lat', 'k.lon')} <= 40")
def spatial_hash_pairs(s: Scene) -> DataFrame:
    strikes = s.strikes().select("strike_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    return range_join(s.pins(), strikes, 40.0).select("pin_id", "strike_id", geo.half_up(F.col("km"), 5).alias("km"))


@query(f"with k as ({STRIKES.format(events='events')}) select strike_id, cast(floor(lat / (6.5e0 / 111e0)) as bigint) as cy, cast(floor(lon / (6.5e0 / (111e0 * greatest(cos(radians(55.15e0)), 0.25e0)))) as bigint) as cx from k")
def spatial_cell_key(s: Scene) -> DataFrame:
    """The cell of each strike, of one width for all, sized at the northern edge."""
    wide = geo.lon_degrees(6.5, 55.15)
    return s.strikes().select("strike_id", F.floor(F.col("lat") / geo.lat_degrees(6.5)).alias("cy"), F.floor(F.col("lon") / wide).alias("cx"))


@query(f"with {NUM}, {CORES} select frame_time, sample_id, level, lat, lon from cores")
def strict_cores(s: Scene) -> DataFrame:
    return M.strict_cores(_samples(s)).select("frame_time", "sample_id", "level", "lat", "lon")


@query(f"{COMP} select frame_time, sample_id, component from comp")
def segment_components(s: Scene) -> DataFrame:
    return M.components(_samples(s)).select("frame_time", "sample_id", "component")


@query(f"{MASS} select frame_time, sample_id, mass_id from members")
def segment_masses(s: Scene) -> DataFrame:
    return _members(s).select("frame_time", "sample_id", "mass_id")


@query(f"{COMP}, {CORES} select frame_time, sample_id, core from (select a.frame_time, a.sample_id, b.sample_id as core, row_number() over (partition by a.frame_time, a.sample_id order by {_AB}, b.sample_id) as rn from num a join comp ca on ca.frame_time = a.frame_time and ca.sample_id = a.sample_id join cores b on a.frame_time = b.frame_time join comp cb on cb.frame_time = b.frame_time and cb.sample_id = b.sample_id and ca.component = cb.component) q where rn = 1")
def nearest_core(s: Scene) -> DataFrame:
    """The nearest strict core in each sample's component."""
    rows = _samples(s)
    found = M.components(rows).select("frame_time", "sample_id", "component", "lat", "lon")
    cores = M.strict_cores(rows).select("frame_time", "sample_id").join(found, ["frame_time", "sample_id"]).select("frame_time", "component", F.col("sample_id").alias("core"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    near = F.struct(geo.haversine("lat", "lon", "c_lat", "c_lon").alias("d"), F.col("core").alias("core"))
    return found.join(cores, ["frame_time", "component"]).groupBy("frame_time", "sample_id").agg(F.min(near)["core"].alias("core"))


@query(f"{MASS} select frame_time, mass_id, {_rs('lat', 'lon')} from summ")
def mass_centroid(s: Scene) -> DataFrame:
    return _summary(s).select("frame_time", "mass_id", *_r("lat", "lon"))


@query(f"{MASS} select frame_time, mass_id, n, max_level, {_rs('mean_level')} from summ")
def mass_summary(s: Scene) -> DataFrame:
    return _summary(s).select("frame_time", "mass_id", "n", "max_level", *_r("mean_level"))


_SEED = S.km("s_lat", "s_lon", "lat", "lon")


@query(f"""{MASS}, p1 as (select *, count(*) filter (level >= 2) over (partition by frame_time, mass_id) as strong from members), p2 as (select *, first_value(lat) over o as s_lat, first_value(lon) over o as s_lon from p1 where strong < 3 or level >= 2 window o as (partition by frame_time, mass_id order by level desc, lat, lon)),
p3 as (select *, {_SEED} <= 18 as near, count(*) filter ({_SEED} <= 18) over (partition by frame_time, mass_id) as local from p2) select frame_time, mass_id, {near_sql('sum(lat * level) / sum(level)', 6)} as lat, {near_sql('sum(lon * level) / sum(level)', 6)} as lon from p3 where near or local < 3 group by frame_time, mass_id""")
def mass_anchor(s: Scene) -> DataFrame:
    return M.anchors(_members(s)).select("frame_time", "mass_id", *_r("lat", "lon"))


@query(f"{MASS} select frame_time, mass_id, row_number() over (partition by frame_time order by max_level desc, n desc, {S.km('lat', 'lon', '52.1e0', '19.35e0')}, mass_id) as place from summ")
def mass_rank(s: Scene) -> DataFrame:
    return M.ranked(_summary(s), 52.1, 19.35).select("frame_time", "mass_id", "place")


@query(f"""{MASS}, p as ({PIN_SQL}), z as (select max(frame_time) as t from members), d as (select pin_id, mass_id, min({S.km('p.lat', 'p.lon', 'm.lat', 'm.lon')}) as d from p, z join members m on m.frame_time = t group by all),
r as (select mass_id, row_number() over (order by max_level desc, n desc, {S.km('lat', 'lon', '52.1e0', '19.35e0')}, mass_id) as place from summ, z where frame_time = t)
select pin_id, mass_id, {near_sql('d', 6)} as d from (select pin_id, mass_id, d, row_number() over (partition by pin_id order by d, place) as rn from d join r using (mass_id) where d <= 100) q where rn = 1""")
def pin_mass(s: Scene) -> DataFrame:
    last = P.newest(_members(s))
    return M.pin_mass(last, M.summary(last), s.pins()).select("pin_id", "mass_id", *_r("d"))


@query(f"{OVER} select frame_time, mass_id, prev_id, hits from over_")
def mass_overlap(s: Scene) -> DataFrame:
    found = _members(s)
    return M.overlap(found, T.frame_pairs(found)).select("frame_time", "mass_id", "prev_id", "hits")


@query(f"with {samples_sql(peaked=True)}, {TIMES} select * from times")
def frame_pairs(s: Scene) -> DataFrame:
    return T.frame_pairs(samples(s, peaked=True))


def _summary(s: Scene) -> DataFrame:
    return kept(s, "summary", lambda: written(M.summary(_members(s))))


def _matched(s: Scene) -> DataFrame:
    return kept(s, "matched", lambda: written(T.matches(_members(s), _summary(s), T.frame_pairs(_members(s)))))


@query(f"{MATCH} select frame_time, mass_id, prev_id, {_rs('d', 'score')} from matched")
def mass_match(s: Scene) -> DataFrame:
    return _matched(s).select("frame_time", "mass_id", "prev_id", *_r("d", "score"))


def _trails(s: Scene) -> DataFrame:
    return kept(s, "trails", lambda: written(T.trails(_summary(s), _matched(s), T.one_scan(_samples(s)))))


@query(f"{TRAIL} select trail_id, frame_time, mass_id from trail")
def mass_trail(s: Scene) -> DataFrame:
    return _trails(s).select("trail_id", "frame_time", "mass_id")


_LONG = TRAIL.replace(samples_sql(peaked=True), samples_sql(frames=24, peaked=True)).replace(" and t.hop < 6", "")


@query(f"{_LONG} select trail_id, frame_time, mass_id from trail")
def mass_trail_24(s: Scene) -> DataFrame:
    """Trails through a scan of 24 frames, as far back as they go."""
    members = written(M.masses(written(M.numbered(samples(s, frames=24, peaked=True)))))
    found = written(M.summary(members))
    matched = written(T.matches(members, found, T.frame_pairs(members)))
    return T.trails(found, matched, T.one_scan(members)).select("trail_id", "frame_time", "mass_id")


@query(f"{TRAIL} select trail_id, frame_time, n, max_level, {_rs('mean_level')} from trail")
def trail_stats(s: Scene) -> DataFrame:
    return _trails(s).select("trail_id", "frame_time", "n", "max_level", *_r("mean_level"))


@query(f"{MOTION} select trail_id, n, {_rs('moved', 'speed', 'bearing')} from motion")
def trail_motion(s: Scene) -> DataFrame:
    return T.trail_motion(_trails(s)).select("trail_id", "n", *_r("moved", "speed", "bearing"))


@query(f"select user_id, {S.half_up('(degrees(atan2(sum(w * sin(radians(d))), sum(w * cos(radians(d))))) + 360e0) % 360e0', 4)} as bearing from (select user_id, floor(value) % 90 + 40 as d, case when event_id % 4 > 0 then event_id % 4 end as w from events) q group by user_id having sum(w) > 0")
def circular_mean(s: Scene) -> DataFrame:
    turns = s.table("events").select("user_id", (F.floor("value") % 90 + 40).alias("d"), (F.col("event_id") % 4).alias("w"))
    return turns.groupBy("user_id").agg(geo.half_up(T.circular_mean(F.col("d"), F.col("w")), 4).alias("bearing")).where("bearing is not null")


@query(f"""{TRAIL}, e as (select trail_id, count(*) as snaps, min_by(max_level, frame_time) as m0, max_by(max_level, frame_time) as m1, min_by(mean_level, frame_time) as a0, max_by(mean_level, frame_time) as a1, min_by(n, frame_time) as n0, max_by(n, frame_time) as n1 from trail group by trail_id),
v as (select *, m1 - m0 as dm, a1 - a0 as da, (n1 - n0) / n0 as dn, (m1 - m0 >= 1 or a1 - a0 >= 0.35e0) as up, (m1 - m0 <= -1 or a1 - a0 <= -0.35e0) as down from e)
select trail_id, case when snaps < 2 then null when dm >= 1 and not down then 'growing' when dm <= -1 and not up then 'decaying' when up::int + (dn >= 0.25)::int > down::int + (dn <= -0.25)::int and (up or (dn >= 0.25 and da >= 0)) then 'growing' when up::int + (dn >= 0.25)::int < down::int + (dn <= -0.25)::int and (down or (dn <= -0.25 and da <= 0)) then 'decaying' end as trend from v""")
def cell_trend(s: Scene) -> DataFrame:
    return T.trend(_trails(s)).drop("scan_time")


_BK = S.dest("lat", "lon", "((bearing + 180) % 360)", "greatest(case when speed >= 4 then least(speed / 6, speed * 0.175e0) else 8 end, 4e0)")
_SN = S.dest("lat", "lon", "bearing", "(speed * 0.5e0)")
MOVING = f"{MOTION}, moving as materialized (select m.*, s.lat, s.lon, s.max_level, s.n as size from motion m join summ s on s.mass_id = m.trail_id and s.frame_time = (select max(frame_time) from summ))"


def _moving(s: Scene) -> DataFrame:
    return kept(s, "moving", lambda: written(P.newest(_summary(s)).join(T.trail_motion(_trails(s)).drop("n", "scan_time"), F.col("mass_id") == F.col("trail_id"))))


@query(f"{MOVING} select trail_id, {S.half_up(_BK[0], 4)} as back_lat, {S.half_up(_BK[1], 4)} as back_lon, {S.half_up(f'case when speed >= 4 then {_SN[0]} else lat end', 4)} as soon_lat, {S.half_up(f'case when speed >= 4 then {_SN[1]} else lon end', 4)} as soon_lon from moving")
def cell_track(s: Scene) -> DataFrame:
    arrow = T.track(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("speed"))
    return _moving(s).select("trail_id", *[geo.half_up(c, 4).alias(n) for n, c in arrow.items()])


_WAY = S.dest("m.lat", "m.lon", "m.bearing", "(greatest(m.speed, 8e0) * t / 60e0)")
APPROACH = f"""{MOVING}, p as ({PIN_SQL}), way as materialized (select pin_id, trail_id, t, {S.km('p.lat', 'p.lon', *_WAY)} as d from moving m join p on {S.km('p.lat', 'p.lon', 'm.lat', 'm.lon')} <= 100 cross join (select unnest(range(0, 91, 2)) as t) k), ca as materialized (select pin_id, trail_id, d as miss_km, t as miss_min from (select *, row_number() over (partition by pin_id, trail_id order by d, t) as rn from way) q where rn = 1)"""


def _near_pins(s: Scene) -> DataFrame:
    """Moving masses by pins within 100 km of their centre."""
    centres = _moving(s).select("trail_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    near = range_join(s.pins().select("pin_id", F.col("lat").alias("pin_lat"), F.col("lon").alias("pin_lon")), centres, TRACK_KM, ("pin_lat", "pin_lon")).select("pin_id", "pin_lat", "pin_lon", "trail_id")
    return near.join(_moving(s), "trail_id")


@query(f"{APPROACH} select pin_id, trail_id, {_rs('miss_km', digits=4)}, cast(miss_min as int) as miss_min from ca")
def closest_approach(s: Scene) -> DataFrame:
    """How near each moving mass will pass each pin within 100 km of it."""
    return T.closest_approach(_near_pins(s)).select("pin_id", "trail_id", *_r("miss_km", digits=4), "miss_min")


_AH = S.dest("m.lat", "m.lon", "m.bearing", "15e0")
FLAGS = f"""{APPROACH}, nearest as (select pin_id, mass_id as trail_id, min({S.km('p.lat', 'p.lon', 'b.lat', 'b.lon')}) as dn from p, members b where frame_time = (select max(frame_time) from summ) group by all),
geo_ as (select p.pin_id, m.trail_id, m.max_level, m.bearing, m.speed, case when dn <= 100 then dn else {S.km('p.lat', 'p.lon', 'm.lat', 'm.lon')} end as d_now, {S.km('p.lat', 'p.lon', *_AH)} as d_ahead, {S.km('p.lat', 'p.lon', 'm.from_lat', 'm.from_lon')} as d_then from moving m cross join p join nearest n on n.pin_id = p.pin_id and n.trail_id = m.trail_id where {S.km('p.lat', 'p.lon', 'm.lat', 'm.lon')} <= 100),
flags as materialized (select *, d_ahead < d_now - 0.4e0 or d_now < d_then - 0.6e0 as approaching, d_ahead > d_now + 0.4e0 and d_now > d_then + 0.6e0 as receding from geo_)"""


def _flags(s: Scene) -> DataFrame:
    rows = _near_pins(s)
    members = P.newest(_members(s)).select("mass_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    near = range_join(s.pins().select("pin_id", "lat", "lon"), members, TRACK_KM).groupBy("pin_id", "mass_id").agg(F.min("km").alias("dn"))
    lat, lon = geo.destination("lat", "lon", "bearing", 15.0)
    rows = rows.join(near, ["pin_id", "mass_id"], "left").withColumns({"d_now": F.coalesce("dn", geo.haversine("pin_lat", "pin_lon", "lat", "lon")), "d_ahead": geo.haversine("pin_lat", "pin_lon", lat, lon), "d_then": geo.haversine("pin_lat", "pin_lon", "from_lat", "from_lon")})
    now, ahead, then = F.col("d_now"), F.col("d_ahead"), F.col("d_then")
    return T.closest_approach(rows).withColumns({"approaching": (ahead < now - 0.4) | (now < then - 0.6), "receding": (ahead > now + 0.4) & (now > then + 0.6)})


@query(f"{FLAGS} select pin_id, trail_id, {_rs('d_now', digits=4)}, approaching, receding from flags")
def approach_flags(s: Scene) -> DataFrame:
    return _flags(s).select("pin_id", "trail_id", *_r("d_now", digits=4), "approaching", "receding")


_MOVES = f"m as ({MOVES.format(events='events')}), drawn as (select * from (select *, row_number() over (partition by scan_time order by confidence desc, max_level desc, trail_id) as place from m) q where place <= 3)"


@query(f"with {_MOVES} select scan_time, trail_id, place, place = 1 as threatening from drawn")
def top_tracks(s: Scene) -> DataFrame:
    """The three arrows drawn for each scan: the surest masses, of equals the stronger."""
    return TH.tracks(s.moves().withColumns({"bearing": F.lit(0.0), "speed": F.lit(10.0)})).select("scan_time", "trail_id", "place", "threatening")


_OWN = "select scan_time, trail_id % 4 as pin_id, trail_id, now_lat, now_lon, row_number() over (partition by scan_time, trail_id % 4 order by trail_id) as rn from m"


@query(f"""with {_MOVES}, own as (select * from ({_OWN}) q where rn = 1), extra as (select o.* from own o where not exists (select 1 from drawn d where d.scan_time = o.scan_time and abs(d.now_lat - o.now_lat) < 1e-5 and abs(d.now_lon - o.now_lon) < 1e-5))
select scan_time, pin_id, d.trail_id, false as pinned from drawn d join (select distinct scan_time, pin_id from own) o using (scan_time) union all select scan_time, pin_id, trail_id, true from extra""")
def track_union(s: Scene) -> DataFrame:
    """The arrows of each scan, and for each pin that of its own mass where none of them begins there."""
    moves = s.moves().withColumns({"bearing": F.lit(0.0), "speed": F.lit(10.0)})
    own = P.first_by(moves.withColumn("pin_id", F.col("trail_id") % 4), ["scan_time", "pin_id"], F.col("trail_id"))
    return TH.track_union(TH.tracks(moves), own.select("scan_time", "pin_id", "trail_id", "now_lat", "now_lon"))


@query(f"""{FLAGS}, f as (select flags.*, miss_km, miss_min from flags join ca using (pin_id, trail_id) where d_now <= 100), r as (select *, row_number() over (partition by pin_id order by d_now, trail_id) as rn, min(miss_km) over (partition by pin_id) as least from f)
select pin_id, trail_id, {near_sql('least', 4)} as miss_km, miss_km <= 5 as will_hit, cast(miss_min as int) as eta from r where rn = 1""")
def pin_primary(s: Scene) -> DataFrame:
    """The mass that matters to each pin: the nearest within 100 km. The miss is the least of all such masses."""
    rows = _flags(s).where("d_now <= 100").withColumn("least", F.min("miss_km").over(P.Window.partitionBy("pin_id")))
    best = P.first_by(rows, ["pin_id"], F.col("d_now"), F.col("trail_id"))
    return best.select("pin_id", "trail_id", near(F.col("least"), 4).alias("miss_km"), (F.col("miss_km") <= PIN_KM).alias("will_hit"), F.col("miss_min").alias("eta"))


@query(f"with {samples_sql(peaked=True)}, k as ({STRIKES.format(events='events')}) select distinct a.frame_time, a.lat, a.lon from samples a join k b on {_AB} <= 20 where a.level >= 3")
def strike_near_cell(s: Scene) -> DataFrame:
    """Strong samples with a strike within 20 km."""
    cells = samples(s, peaked=True).where("level >= 3").select("frame_time", "lat", "lon")
    strikes = s.strikes().select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    return range_join(cells, strikes, 20.0).select("frame_time", "lat", "lon").distinct()
