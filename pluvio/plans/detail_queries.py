"""Small rules beside the large ones: cells by count, labels, cursors, gates and toggles; the run of a hindcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.operators import alert_rules as R
from pluvio.operators import growth as G
from pluvio.operators import threat as TH
from pluvio.operators import verify as V
from pluvio.operators import warnings as W
from pluvio.plans import sqltext as S
from pluvio.plans.fixtures import MOVES, Scene
from pluvio.plans.grid_queries import samples, samples_sql
from pluvio.plans.motion_queries import _hindcast
from pluvio.plans.registry import query

_KM = "(case when n <= 9000 then 3e0 when ceil(n / 4e0) <= 9000 then 6e0 when ceil(n / 16e0) <= 9000 then 12e0 else 24e0 end)"


@query(f"select l_partkey, {_KM} as cell_km from (select l_partkey, cast(sum(l_quantity) * 100 as bigint) as n from lineitem group by l_partkey) q")
def cell_of_count(s: Scene) -> DataFrame:
    """The cells that frames of so many samples are held in."""
    n = s.table("lineitem").groupBy("l_partkey").agg((F.sum("l_quantity") * 100).cast("long").alias("n"))
    return n.select("l_partkey", V.cell_km_of_count(F.col("n")).alias("cell_km"))


_ISO = "strftime(make_timestamp(cast({t} as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


@query(f"""with {samples_sql(frames=24, peaked=True)}, f as (select frame_time, count(*) as n from samples group by frame_time)
select strftime(make_timestamp(cast(max(frame_time) as bigint) * 1000000), '%Y-%m-%d') as date, {_ISO.format(t='min(frame_time)')} as radar_from, {_ISO.format(t='max(frame_time)')} as radar_to, count(*) as frames, cast(77 as bigint) as latest_age_sec, list_sort(list(distinct {_KM})) as cell_kms, min(n) as least, max(n) as most from f""")
def hindcast_run(s: Scene) -> DataFrame:
    """What a hindcast says of the frames it ran on, fetched 77 seconds after the last."""
    rows = samples(s, frames=24, peaked=True)
    return V.run_facts(rows, F.lit(1704067200 + 23 * 300 + 77))


@query()
def hindcast_summary(s: Scene) -> DataFrame:
    """A hindcast as one document in JSON."""
    facts = V.run_facts(samples(s, frames=24, peaked=True), F.lit(1704067200 + 23 * 300 + 77))
    return V.summary(_hindcast(s), facts, F.timestamp_seconds(F.lit(1704067200 + 23 * 300 + 100)))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'powiat ' || lower(c_name) else 'powiat ' || lower(c_name) end as label from customer")
def county_labels(s: Scene) -> DataFrame:
    """Counties' names, with what they are before them or not."""
    name = F.lower("c_name")
    return s.table("customer").select("c_custkey", W.county_label(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("powiat "), name)).otherwise(name)).alias("label"))


@query(f"select event_id, {S.half_up('least(1e0, greatest(0e0, (value - 50) / 90e0))', 6)} as at from events")
def now_cursor(s: Scene) -> DataFrame:
    """Where now stands on the strip, for radar of some age, or from the future."""
    return s.table("events").select("event_id", (F.floor(R.now_cursor(F.col("value") - 50) * 1e6 + 0.5) / 1e6).alias("at"))


@query("select user_id, count(distinct cast(ts as date)) filter (event_type = 'error') >= 3 as passes from events group by user_id")
def growth_gate(s: Scene) -> DataFrame:
    """Whether a trend may count: by the days on record of each user, those of errors being the stormy ones."""
    days = s.table("events").groupBy("user_id").agg(F.countDistinct(F.when(F.col("event_type") == "error", F.to_date("ts"))).alias("days"))
    return days.select("user_id", G.gate_passes(F.col("days")).alias("passes"))


_DRAWN = f"m as ({MOVES.format(events='events')}), drawn as (select * from (select *, row_number() over (partition by scan_time order by confidence desc, max_level desc, trail_id) as place from m) q where place <= 3)"


@query(f"with {_DRAWN} select scan_time, trail_id, place from drawn where scan_time % 3 = 1")
def map_tracks(s: Scene) -> DataFrame:
    """The arrows on the maps that show them: a third do, a third do not, and of a third nothing is known."""
    moves = s.moves().withColumns({"bearing": F.lit(0.0), "speed": F.lit(10.0)})
    scans = moves.select("scan_time").distinct().where("scan_time % 3 > 0").select("scan_time", (F.col("scan_time") % 3 == 1).alias("shown"))
    return TH.tracks_on_map(TH.tracks(moves), scans).select("scan_time", "trail_id", "place")


_LEVELS = (("wet", 1), ("strong", 2), ("core", 3))


@query(f"with {samples_sql()} select frame_time, {', '.join(f'count(*) filter (level >= {n}) as {name}' for name, n in _LEVELS)} from samples group by frame_time")
def class_filters(s: Scene) -> DataFrame:
    """Samples of each frame that are wet, that motion looks at, and that may be cores."""
    return samples(s).groupBy("frame_time").agg(*[F.count_if(F.col("level") >= n).alias(name) for name, n in _LEVELS])


@query(f"with {samples_sql(frames=24, peaked=True)}, f as (select frame_time, row_number() over (order by frame_time) as n, max(frame_time) over () as last from (select distinct frame_time from samples) q) select frame_time from f where n >= 4 and frame_time + 3600 <= last")
def scorable_frames(s: Scene) -> DataFrame:
    """The frames that a hindcast can score: three before, an hour after."""
    return V.scored_frames(samples(s, frames=24, peaked=True))
