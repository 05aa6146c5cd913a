"""What streams do, over tables: looks at a folder, strikes beside cells, episodes and their delivery; tiles, covers and plain SQL."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo, sql
from pluvio.functions.const import LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, NEAREST_COLOUR, TOWARD_PL
from pluvio.operators import cover
from pluvio.operators.stages import shared_folder, written
from pluvio.plans import sqltext as S
from pluvio.plans.alert_queries import _lines
from pluvio.plans.decision_queries import _SQ, _points, _squares
from pluvio.plans.fixtures import PINS, Scene, hits_sql
from pluvio.plans.geo_queries import _PIXELS, _pixels
from pluvio.plans.grid_queries import samples, samples_sql
from pluvio.plans.mass_queries import near, near_sql
from pluvio.plans.registry import query
from pluvio.sources import polling, tiles
from pluvio.streaming import alerts, delivery, episodes
from pluvio.streaming.strikes import strikes_by_cell


@query(f"with {samples_sql()} select frame_time, lat, lon, level, rate, cell_km from samples where frame_time in (select distinct frame_time from samples order by frame_time desc limit 4)")
def polled_frames(s: Scene) -> DataFrame:
    """The newest four frames of a folder of frames, by the source that polls it."""
    folder = f"{shared_folder(s.spark)}/frames-{uuid.uuid4().hex}"
    samples(s).withColumn("level", F.col("level").cast("int")).write.partitionBy("frame_time").parquet(folder)
    return polling.newest_frames(s.spark, folder, 4)


#: Strikes of three quarters of an hour around the frames, and the frames' strong samples.
_STRUCK = "select event_id as strike_id, 1704066300 + event_id % 2700 as struck, 50.0e0 + (event_id % 4) * 0.9e0 + (event_id % 13 - 6) * 0.03e0 as lat, 17.0e0 + (event_id % 4) * 1.3e0 + (event_id % 17 - 8) * 0.04e0 as lon from {events} where event_type = 'error'"
_CELL = "floor(lat * 1000 + 0.5e0) * 100000 + floor(lon * 1000 + 0.5e0)"
_KM = S.km("c.lat", "c.lon", "k.lat", "k.lon")


def cells_and_strikes(s: Scene) -> tuple[DataFrame, DataFrame]:
    cells = samples(s, peaked=True).where("level >= 3").select(F.expr(_CELL.replace("e0", "D")).cast("long").alias("cell_id"), F.timestamp_seconds("frame_time").alias("seen_at"), "lat", "lon")
    strikes = s.sql(_STRUCK).select("strike_id", F.timestamp_seconds("struck").alias("struck_at"), "lat", "lon")
    return cells, strikes


@query(f"""with {samples_sql(peaked=True)}, c as (select cast({_CELL} as bigint) as cell_id, frame_time, lat, lon from samples where level >= 3), k as ({_STRUCK.format(events='events')})
select cell_id, frame_time as seen, strike_id, struck, {near_sql(_KM, 6)} as km from c join k on struck <= frame_time and struck >= frame_time - 900 where {_KM} <= 20""")
def strike_cell_interval(s: Scene) -> DataFrame:
    """Each strike within 20 km of a strong cell in the 15 minutes before its frame."""
    found = strikes_by_cell(*cells_and_strikes(s))
    return found.select("cell_id", F.unix_timestamp("seen_at").alias("seen"), "strike_id", F.unix_timestamp("struck_at").alias("struck"), near(F.col("km"), 6).alias("km"))


def pin_rows(s: Scene) -> DataFrame:
    """Threats of each pin, and among them pins that move, settings that change and reloads."""
    rows = _lines(s).withColumns({"ts": F.col("ts").cast("timestamp"), "timeline_advected": F.col("event_id") % 2 == 0}).withColumnRenamed("level", "cell_level")
    n = F.col("event_id")
    kind = F.when(n % 11 == 3, "place").when(n % 13 == 5, "settings").when(n % 7 == 2, "reload").otherwise("threat")
    on = kind == "settings"
    return rows.withColumns({
        "kind": kind, "lat": 50 + (n % 3) / 10, "lon": 20 + F.col("pin_id") % 2, "lead_min": F.when(on & (n % 2 == 0), (15 + n % 4 * 15).cast("int")), "min_level": F.when(on, (1 + n % 3).cast("int")), "enabled": F.when(on, n % 5 > 0),
    })


@query()
def episode_replay(s: Scene) -> DataFrame:
    """The events that each pin's threats fire while it is moved, set and reloaded."""
    return episodes.replay(pin_rows(s))


@query()
def alert_delivery(s: Scene) -> DataFrame:
    """The events of the replay as they were delivered: two batches, the second with some of the first's, and delivered twice; quiet from 22 to 6."""
    path = f"{shared_folder(s.spark)}/delivered-{uuid.uuid4().hex}"
    events, deliver = written(alerts.replay(_lines(s).withColumnRenamed("level", "cell_level"))), delivery.sink(path, 22, 6)  # read by each delivery
    deliver(events.where("pin_id % 2 = 0"), 0)
    for _ in range(2):
        deliver(events.where("pin_id % 2 = 1 or pin_id % 3 = 0"), 1)
    return delivery.delivered(s.spark, path)


# Tiles as files.

_TILE = "1704067200 + p_partkey % 3 * 600 as frame_time, 35 + p_partkey % 2 as x, 20 + cast(floor(p_partkey / 2) as bigint) % 2 as y, p_partkey * 7 % 256 as px, p_size * 5 % 256 as py"
#: One pixel for each place of a tile; one frame lacks a tile.
_ON_TILES = f"select * from (select p_partkey, frame_time, x, y, px, py, row_number() over (partition by frame_time, x, y, px, py order by p_partkey) as rn from (select p_partkey, {_TILE} from {{part}}) o) q where rn = 1 and not (frame_time = 1704067800 and x = 36 and y = 21)"


def _as_png(pixels: pd.DataFrame, filters: int = 5) -> bytes:
    """A tile of 256 by 256 as PNG; each row by another of the format's filters."""
    rgba = np.zeros((256, 256, 4), dtype=np.uint8)
    rgba[pixels["py"], pixels["px"]] = pixels[["r", "g", "b", "a"]]
    left, above, corner = (np.zeros_like(rgba).astype(int) for _ in range(3))
    left[:, 1:], above[1:], corner[1:, 1:] = rgba[:, :-1], rgba[:-1], rgba[:-1, :-1]
    guess = left + above - corner
    a, b, c = (abs(guess - n) for n in (left, above, corner))
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    taken = np.stack([np.zeros_like(left), left, above, (left + above) // 2, paeth])
    how = np.arange(256) % filters
    rows = ((rgba - taken[how, np.arange(256)]) % 256).astype(np.uint8).reshape(256, -1)
    body = np.concatenate((how[:, None].astype(np.uint8), rows), axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return tiles.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 256, 256, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def write_tiles(pixels: DataFrame, folder: str) -> None:
    """``pixels`` (frame_time, x, y, px, py, r, g, b, a) as a file for each tile. A file is written beside its place and then moved, so that a task that runs twice leaves one whole file."""

    def write(own: pd.DataFrame) -> pd.DataFrame:
        from pluvio.sources.polling import _store

        frame, x, y = (int(own[c].iloc[0]) for c in ("frame_time", "x", "y"))
        store, root = _store(folder)
        store.create_dir(f"{root}/{frame}/{x}", recursive=True)
        beside = f"{root}/{frame}/{x}/{y}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(beside) as file:
            file.write(_as_png(own))
        store.move(beside, f"{root}/{frame}/{x}/{y}.png")
        return pd.DataFrame({"n": [len(own)]})

    pixels.groupBy("frame_time", "x", "y").applyInPandas(write, "n long").agg(F.sum("n")).collect()  # one row


def _scanned(s: Scene) -> tuple[DataFrame, DataFrame]:
    folder = f"{shared_folder(s.spark)}/tiles-{uuid.uuid4().hex}"
    at = s.spark.sql(_ON_TILES, part=s.table("part"))
    write_tiles(at.drop("rn").join(_pixels(s), "p_partkey"), folder)
    cover = at.select("x", "y").distinct()
    return tiles.scan_tiles(s.spark, folder, cover)


_AT_LAT = "degrees(atan(sinh(pi() * (1 - 2 * (y + py / 256e0) / 64e0))))"
_AT_LON = "((x + px / 256e0) / 64e0 * 360 - 180)"


@query(f"""{_PIXELS}, d as (select p_partkey, a, pow(r - rgb // 65536, 2) + pow(g - (rgb // 256) % 256, 2) + pow(b - rgb % 256, 2) as d, i, dbz from px, pal),
n as (select p_partkey, a, d, dbz, row_number() over (partition by p_partkey order by d, i) as rn from d), k as (select p_partkey, dbz from n where rn = 1 and a >= 200 and d < {NEAREST_COLOUR**2}), o as ({_ON_TILES.format(part='part')})
select frame_time, {S.half_up(_AT_LAT, 5)} as lat, {S.half_up(_AT_LON, 5)} as lon, {S.half_up('pow(pow(10e0, dbz / 10e0) / 200e0, 1 / 1.6e0)', 4)} as rate from o join k using (p_partkey)
where px % 2 = 0 and py % 2 = 0 and {_AT_LAT} between {LAT_MIN} and {LAT_MAX} and {_AT_LON} between {LON_MIN} and {LON_MAX}""")
def tile_scan(s: Scene) -> DataFrame:
    """Rain read from tiles as files, of every kind of row."""
    hits, _ = _scanned(s)
    return hits.select("frame_time", geo.half_up(F.col("lat"), 5).alias("lat"), geo.half_up(F.col("lon"), 5).alias("lon"), geo.half_up(F.col("rate"), 4).alias("rate"))


@query(f"with o as ({_ON_TILES.format(part='part')}), c as (select count(*) as n from (select distinct x, y from o) q) select frame_time, count(distinct (x, y)) = max(n) as complete from o, c group by frame_time")
def tile_scan_complete(s: Scene) -> DataFrame:
    """Whether every tile of a frame came."""
    return _scanned(s)[1]


# Counties by their cells.


@query(f"""with {_SQ}, hit as (select pin_id, code from pt join sq on pt.lon >= sq.lon - 1 and pt.lon < sq.lon + 1 and pt.lat >= sq.lat - 0.6e0 and pt.lat < sq.lat + 0.6e0 and not (k % 2 = 1 and pt.lon >= sq.lon - 0.3e0 and pt.lon < sq.lon + 0.3e0 and pt.lat >= sq.lat - 0.2e0 and pt.lat < sq.lat + 0.2e0))
select code, count(*) as n from hit group by code""")
def county_cover(s: Scene) -> DataFrame:
    """Points in each county, a point in each that holds it, by the counties' cells."""
    found = cover.in_cells(_points(s), cover.cover(_squares(s))).where(F.col("inside") | cover._held())
    return found.groupBy("code").agg(F.count("*").alias("n"))


# SQL alone.

_BOTH = f"h as ({hits_sql()}), p as ({PINS.format(nation='nation')}), x as (select h.event_id, h.lat, h.lon, h.rate, p.lat as plat, p.lon as plon from h join p on p.pin_id = h.event_id % 25)"
_TURN = S.turn("lat", "lon", "plat", "plon")
_TO = S.dest("lat", "lon", _TURN, "50e0")


@query(f"""with {_BOTH} select event_id, {S.half_up(S.km('lat', 'lon', 'plat', 'plon'), 6)} as km, {S.half_up(S.turn('lat', 'lon', 'plat', 'plon'), 6)} as bearing, {S.level('rate')} as level, {S.pick(('brak', 'słaby', 'umiarkowany', 'silny', 'ulewny'), S.level('rate'))} as label,
{S.half_up(_TO[0], 6)} as to_lat, {S.half_up(_TO[1], 6)} as to_lon, {S.pick(TOWARD_PL, f"(cast({S.half_up(f'{_TURN} / 45e0')} as bigint) % 8)")} as toward from x""")
def sql_geometry(s: Scene) -> DataFrame:
    """Distances, directions and classes of hits, in SQL with the library's functions."""
    sql.register(s.spark)
    text = _BOTH.replace("e0", "D")
    return s.spark.sql(
        f"""with {text} select event_id, half_up(haversine_km(lat, lon, plat, plon), 6) as km, half_up(bearing_deg(lat, lon, plat, plon), 6) as bearing, rain_level(rate) as level, rain_level_name(rain_level(rate)) as label,
  half_up(destination(lat, lon, bearing_deg(lat, lon, plat, plon), 50).lat, 6) as to_lat, half_up(destination(lat, lon, bearing_deg(lat, lon, plat, plon), 50).lon, 6) as to_lon, going_toward(bearing_deg(lat, lon, plat, plon)) as toward from x""".replace("from events", "from {events}").replace("from nation", "from {nation}"),
        events=s.table("events"), nation=s.table("nation"),
    )


@query(f"""{_PIXELS}, d as (select p_partkey, a, pow(r - rgb // 65536, 2) + pow(g - (rgb // 256) % 256, 2) + pow(b - rgb % 256, 2) as d, i, dbz from px, pal),
n as (select p_partkey, a, d, dbz, row_number() over (partition by p_partkey order by d, i) as rn from d)
select dbz, count(*) as n from (select case when a >= 200 and d < {NEAREST_COLOUR**2} then dbz end as dbz from n where rn = 1) q where dbz is not null group by dbz""")
def sql_palette(s: Scene) -> DataFrame:
    """Pixels by dBZ, by the Arrow table functions in SQL."""
    sql.register(s.spark)
    pixels = _pixels(s).select(F.col("p_partkey").alias("id"), "r", "g", "b", "a")
    return s.spark.sql("select p.dbz, count(*) as n from pixel_dbz(table(select * from {pixels})) d join radar_palette() p on p.dbz = d.dbz group by p.dbz", pixels=pixels)
