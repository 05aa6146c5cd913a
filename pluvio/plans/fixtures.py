"""Scenes derived from the star-schema tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Seven radar frames, five minutes apart, of four moving blobs.
HITS = """select event_id, f as frame_no, 1704067200 + f * 300 as frame_time, b as blob_no,
 50.0e0 + b * 0.9e0 + f * (b - 1) * 0.012e0 + (cast(floor(c / 7) as bigint) - 3) * 0.028e0 as lat,
 17.0e0 + b * 1.3e0 + f * (b + 1) * 0.024e0 + ((c % 7) - 3) * 0.045e0 as lon,
 {rate} as rate
from (select event_id, f, k % 4 as b, cast(floor(k / 4) as bigint) % 49 as c, value
 from (select event_id, event_id % {frames} as f, cast(floor(event_id / {frames}) as bigint) as k, value from {events}) q) p"""
FLAT = "floor(value * 10 + 0.5) / 100.0e0"
#: Brightest in the middle of each blob.
PEAKED = "floor(value / (1 + 2 * greatest(abs(cast(floor(c / 7) as bigint) - 3), abs(c % 7 - 3))) * 10 + 0.5) / 100.0e0"
PINS = """select n_nationkey as pin_id, n_name as label, 49.3e0 + (n_nationkey % 5) * 1.2e0 as lat,
 15.0e0 + cast(floor(n_nationkey / 5) as bigint) * 2.0e0 as lon from {nation}"""
STRIKES = """select event_id as strike_id, ts, 50.0e0 + (event_id % 4) * 0.9e0 + (event_id % 13 - 6) * 0.03e0 as lat,
 17.0e0 + (event_id % 4) * 1.3e0 + (event_id % 17 - 8) * 0.04e0 as lon from {events} where event_type = 'error'"""
WARNINGS = """select o_orderkey as id, 1 + o_orderkey % 3 as degree,
 case substr(o_orderpriority, 1, 1) when '1' then 'Burze z gradem' when '2' then 'Intensywne opady deszczu' when '3' then 'Silny wiatr' when '4' then 'Upał' else 'Ulewa' end as event,
 o_orderdate as starts, lpad(cast(200 + o_custkey % 25 as varchar(9)), 4, '0') as code_a, lpad(cast(200 + (o_custkey + 7) % 25 as varchar(9)), 4, '0') as code_b
from {orders}"""
THREATS = """select event_id, user_id as pin_id, ts, cast(floor(value) as bigint) % 100 as chance,
 case when event_id % 5 = 0 then null else cast(floor(value / 4) as bigint) % 60 end as eta,
 case when event_id % 7 = 0 then null else floor(value * 10 + 0.5) / 40.0e0 end as nearest_km,
 cast(floor(value / 100) as bigint) as level, cast(floor(value / 3) as bigint) % 5 as pin_level,
 event_type in ('click', 'view') as will_hit, event_id % 3 = 0 as approaching, event_id % 4 = 1 as receding,
 case when event_id % 6 = 0 then null else floor(value * 10 + 0.5) / 100.0e0 end as miss_km,
 case when event_id % 9 = 0 then event_id % 3 + 1 else null end as degree from {events}"""
SKILL = """select l_orderkey, 10 * (1 + l_linenumber % 6) as lead, l_discount >= 0.05 as pred, l_tax >= 0.04 as obs,
 5 + 5 * cast(floor(l_quantity) as bigint) % 95 as chance from {lineitem}"""


def hits_sql(frames: int = 7, peaked: bool = False, events: str = "events") -> str:
    return HITS.format(rate=PEAKED if peaked else FLAT, frames=frames, events=events)


#: Motions of masses as given rows: scans by user, sure to some degree, arrows that begin on a coarse lattice.
MOVES = """select user_id as scan_time, event_id as trail_id, 72 + cast(floor(value) as bigint) % 27 as confidence, 1 + event_id % 4 as max_level,
 50.0e0 + event_id % 5 * 0.5e0 as now_lat, 17.0e0 + event_id % 7 * 0.5e0 as now_lon from {events}"""


class Scene:
    """The scenes over the tables in one folder. ``stages`` holds what one query needs more than once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self.stages: dict[str, Any] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, **tables: str) -> DataFrame:
        return self.spark.sql(text, **{k: self.table(k) for k in ("events", "nation", "orders", "lineitem") if "{" + k + "}" in text})

    def hits(self, frames: int = 7, peaked: bool = False) -> DataFrame:
        return self.sql(hits_sql(frames, peaked, "{events}"))

    def pins(self) -> DataFrame:
        return self.sql(PINS)

    def strikes(self) -> DataFrame:
        return self.sql(STRIKES)

    def warnings(self) -> DataFrame:
        return self.sql(WARNINGS)

    def threats(self) -> DataFrame:
        return self.sql(THREATS)

    def moves(self) -> DataFrame:
        return self.sql(MOVES)

    def skill(self) -> DataFrame:
        return self.sql(SKILL)
