"""Wire formats, listings, strike files and source failover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions import classify, geo
from pluvio.functions.const import AEQD_LAT, AEQD_LON, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN
from pluvio.operators import warnings as W
from pluvio.plans import sqltext as S
from pluvio.plans.decision_queries import NOW, WARN, _warnings
from pluvio.plans.fixtures import STRIKES, Scene
from pluvio.plans.geo_queries import _PIXELS, _pixels
from pluvio.plans.grid_queries import PIN_SQL, samples, samples_sql
from pluvio.plans.registry import query
from pluvio.sources import feeds, wire


def _word(x: str) -> str:
    h = f"lpad(to_hex(cast(greatest(0, least(65535, floor({x} + 0.5e0))) as bigint)), 4, '0')"
    return f"substr({h}, 3, 2) || substr({h}, 1, 2)"


_RECORD = " || ".join(map(_word, ("(lat - 48e0) * 1000", "(lon - 11e0) * 1000", "level", "rate * 10")))


@query(f"with {samples_sql()} select frame_time, base64(unhex(string_agg({_RECORD}, '' order by level desc, lat, lon))) as packed, cast(count(*) as int) as n from samples group by frame_time")
def pack_samples(s: Scene) -> DataFrame:
    return wire.pack(samples(s))


_BACK = "48e0 + floor((lat - 48e0) * 1000 + 0.5e0) / 1000e0 as lat, 11e0 + floor((lon - 11e0) * 1000 + 0.5e0) / 1000e0 as lon, level, floor(rate * 10 + 0.5e0) / 10e0 as rate"


@query(f"with {samples_sql()} select frame_time, {_BACK} from samples")
def unpack_samples(s: Scene) -> DataFrame:
    """Samples that were packed, read back."""
    return wire.pack(samples(s)).select("frame_time", F.inline(wire.unpack(F.col("packed"))))


@query(f"""with {samples_sql()}, n as (select frame_time, cast((frame_time - 1704067200) / 300 as bigint) as k, count(*) as n from samples group by all)
select k as scan_id, frame_time, cast(n as int) as n, case when k % 2 = 1 then 3e0 else 6e0 end as cell_km from n union all select k, frame_time - 300, 1, 6e0 from n where k % 2 = 0 and k % 4 = 0""")
def frames_from_scan(s: Scene) -> DataFrame:
    """Scans of both shapes: odd ones hold a packed history, even ones their latest frame and every other of these one before it."""
    k = F.floor((F.col("frame_time") - 1704067200) / 300)
    odd, one = k % 2 == 1, F.array(F.struct(F.lit(50.0).alias("lat"), F.lit(20.0).alias("lon"), F.lit(1).alias("level"), F.lit(0.5).alias("rate")))
    none = F.array().cast(wire.SAMPLES)
    past = F.array(F.struct(F.col("frame_time").alias("time"), none.alias("samples"), "packed", F.lit(3.0).alias("cell_km")))
    scans = wire.pack(samples(s)).select(
        k.alias("scan_id"), F.lit(6.0).alias("cell_km"), F.when(odd, past).otherwise(F.filter(past, lambda x: F.lit(False))).alias("history"), F.col("frame_time").alias("latest_time"),
        wire.unpack(F.col("packed")).alias("samples"), (F.col("frame_time") - 300).alias("prev_time"), F.when(k % 4 == 0, one).otherwise(none).alias("prev_samples"),
    )
    return wire.frames_of_scans(scans).select("scan_id", "frame_time", F.size("samples").alias("n"), "cell_km")


_LOADS = "select event_id, event_id % 50 as scan_id, case when event_id % 3 = 0 and event_id % 50 % 5 <> 0 then 'sri' else 'tile' end as source, event_id % 17 = 0 as degraded from events"


def _loads(s: Scene) -> DataFrame:
    return s.sql(_LOADS.replace("from events", "from {events}"))


@query(f"with l as ({_LOADS}), b as (select scan_id, bool_or(source = 'sri') as sri from l group by scan_id) select scan_id, source, count(*) as frames from l join b using (scan_id) where (source = 'sri') = sri group by all")
def source_failover(s: Scene) -> DataFrame:
    """Frames of the preferred source where it has any, of the other one elsewhere."""
    return wire.prefer_source(_loads(s)).groupBy("scan_id", "source").agg(F.count("*").alias("frames"))


@query(f"with l as ({_LOADS}) select scan_id, bool_or(degraded) as degraded from l group by scan_id")
def history_degraded(s: Scene) -> DataFrame:
    return _loads(s).groupBy("scan_id").agg(F.bool_or("degraded").alias("degraded"))


@query(f"""with {samples_sql()}, {WARN}, k as ({STRIKES.format(events='events')}) select (select max(frame_time) from samples) as radar_time, (select count(*) from samples where frame_time = (select max(frame_time) from samples)) as n_samples,
false as radar_unavailable, (select count(*) from w where storm and {NOW} <= ends) as n_warnings, false as warnings_unavailable, (select count(*) from k) as n_strikes, false as lightning_unavailable""")
def snapshot_assemble(s: Scene) -> DataFrame:
    """One row from three sources, each of which may fail alone."""
    return _snapshot(s, s.strikes())


@query(f"""with {samples_sql()}, {WARN}, k as ({STRIKES.format(events='events')}) select (select max(frame_time) from samples) as radar_time, (select count(*) from samples where frame_time = (select max(frame_time) from samples)) as n_samples,
false as radar_unavailable, (select count(*) from w where storm and {NOW} <= ends) as n_warnings, false as warnings_unavailable, cast(0 as bigint) as n_strikes, true as lightning_unavailable""")
def snapshot_degraded(s: Scene) -> DataFrame:
    """The same where the strikes can be read up to one that cannot."""
    strikes = s.strikes()
    last = F.broadcast(strikes.agg(F.max("strike_id").alias("last")))  # one row
    lat = F.when(F.col("strike_id") == F.col("last"), F.raise_error(F.lit("a strike is cut off")).cast("double")).otherwise(F.col("lat"))
    broken = strikes.crossJoin(last).withColumn("lat", lat).where("lat > 0")
    return _snapshot(s, broken)


def _snapshot(s: Scene, strikes: DataFrame) -> DataFrame:
    def radar_() -> DataFrame:
        frames = samples(s).groupBy("frame_time").agg(F.count("*").alias("n"))
        return frames.agg(F.max("frame_time").alias("radar_time"), F.max_by("n", "frame_time").alias("n_samples"))

    radar = feeds.attempt(radar_)
    live = feeds.attempt(lambda: _warnings(s).where(F.col("storm") & W.is_live(F.col("ends"), F.expr(NOW))).agg(F.count("*").alias("n_warnings")))
    lightning = feeds.attempt(lambda: strikes.agg(F.count("*").alias("n_strikes")))
    one = s.spark.range(1).select(F.lit(None).cast("long").alias("radar_time"), F.lit(0).cast("long").alias("n_samples"), F.lit(0).cast("long").alias("n_warnings"), F.lit(0).cast("long").alias("n_strikes"))
    parts = [(found if found is not None else one.select(*names), found is None, flag) for found, names, flag in ((radar, ("radar_time", "n_samples"), "radar_unavailable"), (live, ("n_warnings",), "warnings_unavailable"), (lightning, ("n_strikes",), "lightning_unavailable"))]
    row = parts[0][0].crossJoin(parts[1][0]).crossJoin(parts[2][0])  # one row each
    return row.withColumns({flag: F.lit(down) for _, down, flag in parts}).withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


@query(f"with l as ({_LOADS}), b as (select scan_id, bool_or(degraded) and scan_id % 3 = 0 as down from l group by scan_id) select event_id, scan_id from l join b using (scan_id) where not down")
def trust_gate(s: Scene) -> DataFrame:
    """Threats of scans whose radar was there; a third of the degraded ones counts as down."""
    rows = _loads(s)
    down = F.bool_or("degraded") & (F.col("scan_id") % 3 == 0)
    return feeds.trusted(rows.select("event_id", "scan_id"), rows.groupBy("scan_id").agg(down.alias("radar_unavailable")))


@query("""select cast(o_orderkey as varchar) as id, case when o_orderkey % 4 = 0 then 0 else o_orderkey % 3 + 1 end as degree, case when o_orderkey % 3 > 0 then o_orderkey % 90 + 0.5e0 end as probability, case when o_orderkey % 5 = 0 then 'IMGW-PIB' else 'Biuro ' || o_orderkey % 7 end as office,
case when o_orderkey % 7 = 0 then 0 else 2 end as n_codes, case when o_orderkey % 6 = 0 then null else strftime(o_orderdate at time zone 'Europe/Warsaw' at time zone 'UTC', '%Y-%m-%d %H:%M') end as starts, o_orderkey % 2 = 0 as storm from orders""")
def warnings_json(s: Scene) -> DataFrame:
    """A feed of warnings in JSON, one page for each order, with fields that are absent, empty or no numbers."""
    k = F.col("o_orderkey")
    fields = F.struct(
        k.cast("string").alias("id"), F.when(k % 2 == 0, "Burze z gradem").otherwise("Upał").alias("nazwa_zdarzenia"), F.when(k % 4 == 0, "x").otherwise((k % 3 + 1).cast("string")).alias("stopien"), F.when(k % 3 > 0, (k % 90 + 0.5).cast("string")).alias("prawdopodobienstwo"),
        F.when(k % 6 == 0, "wkrótce").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("obowiazuje_od"), F.when(k % 5 > 0, F.concat(F.lit("Biuro "), (k % 7).cast("string"))).alias("biuro"), F.when(k % 7 > 0, F.array(F.lit("0205"), F.lit("0264"))).alias("teryt"),
    )
    found = feeds.official_warnings(s.table("orders").select(F.to_json(F.array(fields)).alias("body")))
    return found.select("id", "degree", "probability", "office", F.size("teryt").alias("n_codes"), F.date_format("starts", "yyyy-MM-dd HH:mm").alias("starts"), "storm")


@query(f"with p as (select pin_id, lpad(cast(200 + pin_id as varchar), 4, '0') as code, lat, lon from ({PIN_SQL}) x) select code, cast(ring as int) as ring, cast(count(*) as int) as n_edges, {S.half_up('min(x)', 3)} as west, {S.half_up('max(y)', 3)} as north from (select code, r as ring, lon + a * case when r = 0 then 1e0 else 0.25e0 end as x, lat + b * case when r = 0 then 0.5e0 else 0.25e0 end as y from p, (values (-1, -1), (1, -1), (1, 1), (-1, 1)) v(a, b), (values (0), (1)) w(r) where r <= pin_id % 2) q group by code, ring")
def county_polygons(s: Scene) -> DataFrame:
    """Counties in JSON, every second with a hole, read and taken apart into edges."""
    ring = lambda w, h: F.array(*[F.array(F.col("lon") + a * w, F.col("lat") + b * h) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    outer, hole = ring(F.lit(1.0), F.lit(0.5)), ring(F.lit(0.25), F.lit(0.25))
    box = F.array(F.col("lon") - 1.0, F.col("lat") - 0.5, F.col("lon") + 1.0, F.col("lat") + 0.5)
    one = F.struct(F.lpad((F.col("pin_id") + 200).cast("string"), 4, "0").alias("t"), F.col("label").alias("n"), box.alias("b"), F.array(F.when(F.col("pin_id") % 2 == 1, F.array(outer, hole)).otherwise(F.array(outer))).alias("g"))
    files = s.pins().select(F.to_json(F.struct(F.lit(1).alias("v"), F.array(one).alias("powiaty"))).alias("body"))
    edges = feeds.county_edges(feeds.counties(files))
    return edges.groupBy("code", "ring").agg(F.count("*").cast("int").alias("n_edges"), geo.half_up(F.min("x1"), 3).alias("west"), geo.half_up(F.max("y1"), 3).alias("north"))


_TILES = "select event_id % 40 as frame_time, 35 + event_id % 3 as x, 20 + cast(floor(event_id / 40) as bigint) % 4 as y from events where event_id % 11 > 0"


@query(f"with t as ({_TILES}), c as (select 35 + i as x, 20 + j as y from range(3) a(i), range(4) b(j) where j < 2), h as (select frame_time, count(*) as had from (select distinct frame_time, x, y from t join c using (x, y)) q group by frame_time) select frame_time, coalesce(had, 0) = 6 as complete from (select distinct frame_time from t) f left join h using (frame_time)")
def frames_complete(s: Scene) -> DataFrame:
    """Whether every tile of the cover came for a frame."""
    cover = s.spark.range(6).select((35 + F.col("id") % 3).alias("x"), (20 + F.floor(F.col("id") / 3)).alias("y"))
    return feeds.complete_frames(s.sql(_TILES.replace("from events", "from {events}")), cover)


@query(f"""with e as (select event_id as k, 35 + event_id % 3 as x, 20 + event_id % 4 as y, event_id % 256 as px, (event_id * 7) % 256 as py, value from events), q as (select k, x, y, px, py from e where px % 2 = 0 and py % 2 = 0),
g as (select k, degrees(atan(sinh(pi() * (1 - 2 * (y + py / 256e0) / 64e0)))) as lat, (x + px / 256e0) / 64e0 * 360 - 180 as lon from q) select k as frame_time, {S.half_up('lat', 5)} as lat, {S.half_up('lon', 5)} as lon, {S.half_up('pow(pow(10e0, 35 / 10e0) / 200e0, 1 / 1.6e0)', 4)} as rate from g where lat between {LAT_MIN} and {LAT_MAX} and lon between {LON_MIN} and {LON_MAX}""")
def tile_stride(s: Scene) -> DataFrame:
    """Every second pixel of tiles both ways, all of the colour of 35 dBZ."""
    k = F.col("event_id")
    pixels = s.table("events").select(k.alias("frame_time"), (35 + k % 3).alias("x"), (20 + k % 4).alias("y"), (k % 256).alias("px"), (k * 7 % 256).alias("py"), F.lit(0xFF).alias("r"), F.lit(0xEE).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))
    return feeds.tile_hits(pixels).select("frame_time", geo.half_up(F.col("lat"), 5).alias("lat"), geo.half_up(F.col("lon"), 5).alias("lon"), geo.half_up(F.col("rate"), 4).alias("rate"))


@query("select c_custkey, case when c_custkey % 3 = 0 then '10.0.0.' || c_custkey % 250 when c_custkey % 2 = 0 then c_mktsegment else 'anon' end as client, case when c_custkey % 5 = 0 then null else lower(c_name) end as search from customer")
def client_keys(s: Scene) -> DataFrame:
    """By whom calls are counted, and how searches are looked up."""
    k = F.col("c_custkey")
    forwarded = F.when(k % 3 == 0, F.concat(F.lit(" 10.0.0."), (k % 250).cast("string"), F.lit(" , 8.8.8.8"))).when(k % 3 == 1, " ")
    query_ = F.when(k % 5 == 0, " a ").otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    return s.table("customer").select("c_custkey", feeds.client_key(forwarded, F.when(k % 2 == 0, F.col("c_mktsegment"))).alias("client"), feeds.search_key(query_).alias("search"))


_NAMES = "html || ' 2026090' || (1 + page_id % 9) || lpad(cast(page_id % 26 as varchar(2)), 2, '0') || lpad(cast(page_id * 5 % 60 as varchar(2)), 2, '0') || '0000dBR.sri.h5'"
_STAMPED = f"select regexp_extract({_NAMES}, '[0-9]{{16}}dBR.sri.h5$') as name from pages"


@query(f"with n as (select distinct rtrim(name) as name from ({_STAMPED}) q) select name, cast(epoch(try_strptime(substr(name, 1, 14), '%Y%m%d%H%M%S')) as bigint) as frame_time from n where try_strptime(substr(name, 1, 14), '%Y%m%d%H%M%S') is not null")
def listing_parse(s: Scene) -> DataFrame:
    stamped = F.concat("html", F.lit(" 2026090"), (1 + F.col("page_id") % 9).cast("string"), F.lpad((F.col("page_id") % 26).cast("string"), 2, "0"), F.lpad((F.col("page_id") * 5 % 60).cast("string"), 2, "0"), F.lit("0000dBR.sri.h5"))
    return feeds.raster_files(s.table("pages").select(stamped.alias("html")))


_P = "'+proj=aeqd' || case when p_partkey % 3 > 0 then ' +lat_0=' || (p_size + 0.5) else '' end || case when p_partkey % 4 > 0 then ' +lon_0=-' || p_size else '' end"
_RAW = "case p_partkey % 4 when 0 then cast(p_size as varchar(9)) when 1 then ' ' when 2 then 'abc' end"


@query(f"select p_partkey, case when p_partkey % 3 > 0 then p_size + 0.5e0 else {S.num(AEQD_LAT)} end as lat0, case when p_partkey % 4 > 0 then -p_size else {S.num(AEQD_LON)} end as lon0, case when p_partkey % 4 = 0 then p_size else -1e0 end as gain, case when p_partkey % 5 > 0 then 1788220800 + 86400 * (p_partkey % 9) + p_size * 60 end as clock from part")
def odim_attr_parse(s: Scene) -> DataFrame:
    rows = s.spark.sql(f"select p_partkey, p_size, {_P} as projdef, {_RAW} as raw from {{part}}", part=s.table("part"))
    lat, lon = feeds.projection_origin(F.col("projdef"))
    day = F.when(F.col("p_partkey") % 5 == 0, "2026-09").otherwise(F.concat(F.lit("2026090"), (1 + F.col("p_partkey") % 9).cast("string")))
    clock = F.concat(F.lit("00"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("00"))
    return rows.select("p_partkey", lat.alias("lat0"), lon.alias("lon0"), feeds.number_attribute(F.col("raw"), F.lit(-1.0)).alias("gain"), feeds.attribute_clock(day, clock).alias("clock"))


@query("select c_custkey, case when c_custkey % 2 = 0 then c_name when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 5 = 0 then 'wies' when c_custkey % 7 = 0 then 'powiat' when c_custkey % 11 = 0 then 'a' else 'Wybrany punkt' end as label from customer")
def place_label(s: Scene) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, x: F.when(k % n == 0, x).otherwise("")
    return s.table("customer").select("c_custkey", feeds.place_label(pick(2, F.col("c_name")), pick(3, F.col("c_mktsegment")), F.when(k % 5 == 0, "wies"), F.lit(None).cast("string"), pick(7, F.lit("powiat")), pick(11, F.lit("a, b"))).alias("label"))


_HM = S.half_up("pow(pow(10e0, dbz / 10e0) / 200e0, 1 / 1.6e0)", 4)
_TX, _TY, _TZ = "(35 + p_partkey % 3)", "(20 + p_partkey % 4)", 6
_PLAT = f"degrees(atan(sinh(pi() * (1 - 2 * ({_TY} + (p_size * 5 % 256 + 0.5e0) / 256e0) / 64e0))))"
_PLON = f"(({_TX} + (p_partkey % 256 + 0.5e0) / 256e0) / 64e0 * 360 - 180)"


@query(f"""{_PIXELS}, d as (select p_partkey, a, pow(r - rgb // 65536, 2) + pow(g - (rgb // 256) % 256, 2) + pow(b - rgb % 256, 2) as d, i, dbz from px, pal),
n as (select p_partkey, a, d, dbz, row_number() over (partition by p_partkey order by d, i) as rn from d), k as (select p_partkey, dbz from n where rn = 1 and a >= 200 and d < 784)
select * from (select p_partkey, {S.half_up(_PLAT, 5)} as lat, {S.half_up(_PLON, 5)} as lon, {_HM} as rate from k join part using (p_partkey)) q where lat between {LAT_MIN} and {LAT_MAX} and lon between {LON_MIN} and {LON_MAX}""")
def tile_pixels_to_hits(s: Scene) -> DataFrame:
    """Pixels of map tiles with a colour of the palette, as rain at places within the radar's box."""
    k = F.col("p_partkey")
    where = s.table("part").select("p_partkey", (35 + k % 3).alias("x"), (20 + k % 4).alias("y"), (k % 256 + 0.5).alias("px"), (F.col("p_size") * 5 % 256 + 0.5).alias("py"))
    lat, lon = geo.tile_pixel(6, F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    found = classify.colours_to_dbz(_pixels(s)).where("dbz is not null").join(where, "p_partkey")
    rows = found.select("p_partkey", geo.half_up(lat, 5).alias("lat"), geo.half_up(lon, 5).alias("lon"), geo.half_up(classify.rate_of_dbz(F.col("dbz")), 4).alias("rate"))
    return rows.where(F.col("lat").between(LAT_MIN, LAT_MAX) & F.col("lon").between(LON_MIN, LON_MAX))


_STR = f"k as ({STRIKES.format(events='events')})"
_SCLOCK = "timestamp '2024-01-15 12:00:00'"


@query(f"with n as (select distinct strftime(ts, '%Y.%m.%d.%H.%M.ld.csv') as name, date_trunc('minute', ts) as seen from events) select name from n where seen >= {_SCLOCK} - interval 16 minute and seen <= {_SCLOCK} + interval 1 minute order by seen desc limit 16")
def strike_files_in_window(s: Scene) -> DataFrame:
    names = s.table("events").select(F.concat(F.date_format("ts", "yyyy.MM.dd.HH.mm"), F.lit(".ld.csv")).alias("name"))
    return feeds.strike_files(names, F.expr(_SCLOCK)).select("name")


def _files(s: Scene) -> DataFrame:
    """A file for each strike: with or without header, cut by semicolons or commas, places in either order, a time or none."""
    k, lat, lon = F.col("strike_id"), geo.half_up(F.col("lat"), 3).cast("string"), geo.half_up(F.col("lon"), 3).cast("string")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    body = F.when(k % 4 == 0, F.concat_ws("\n", F.lit("czas;lat;lon"), F.concat_ws(";", at, lat, lon)))
    body = body.when(k % 4 == 1, F.concat_ws(",", lon, lat, at)).when(k % 4 == 2, F.concat_ws(";", F.lit("7"), lat, lon)).otherwise(F.lit("<html>moved</html>"))
    name = F.concat(F.date_format("ts", "yyyy.MM.dd.HH.mm"), F.lit(".ld.csv"))
    return s.strikes().select((k % 60).alias("scan_id"), "strike_id", name.alias("name"), body.alias("body"))


@query(f"with {_STR} select {S.half_up('lat', 3)} as lat, {S.half_up('lon', 3)} as lon, cast(epoch(case when strike_id % 4 = 2 then date_trunc('minute', ts) else date_trunc('second', ts) end) as bigint) as at from k where strike_id % 4 < 3")
def strikes_parse(s: Scene) -> DataFrame:
    return feeds.strikes(_files(s)).select("lat", "lon", F.unix_timestamp("at").alias("at"))


@query(f"with {_STR} select strike_id from k where strike_id % 60 not in (select strike_id % 60 from k where strike_id % 4 = 3)")
def strike_scan_gate(s: Scene) -> DataFrame:
    return feeds.whole_scans(_files(s)).select("strike_id")


_DEG = f"deg as (select teryt, max(degree) as degree from (select code_a as teryt, degree, ends, storm from w union all select code_b, degree, ends, storm from w) q where storm and {NOW} <= ends group by teryt)"


def _corner(a: int, b: int) -> str:
    return f"'[' || {S.half_up(f'lon + {a}', 1)} || ',' || {S.half_up(f'lat + {b} * 0.6e0', 1)} || ']'"


@query(f"""with {WARN}, {_DEG}, p as (select lpad(cast(200 + pin_id as varchar), 4, '0') as t, label, lat, lon from ({PIN_SQL}) x) select t, '{{"type":"Feature","properties":{{"t":"' || t || '","n":"' || label || '","degree":' || degree || '}},"geometry":{{"type":"Polygon","coordinates":[[' || {" || ',' || ".join(_corner(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)))} || ']]}}}}' as feature from p join deg on t = teryt""")
def powiat_geojson(s: Scene) -> DataFrame:
    """Counties under a storm warning as features, with its degree."""
    point = lambda a, b: F.array(geo.half_up(F.col("lon") + a, 1), geo.half_up(F.col("lat") + b * F.lit(0.6), 1))
    ring = F.array(*[point(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    counties = s.pins().select(F.lpad((F.col("pin_id") + 200).cast("string"), 4, "0").alias("t"), F.col("label").alias("n"), F.array(F.array(ring)).alias("g"))
    return W.county_features(counties, W.degrees_by_county(_warnings(s).where(F.col("storm") & W.is_live(F.col("ends"), F.expr(NOW)))))
