"""Alert rules, their replay over a trace, labels, and what remains of tracks and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions import geo
from pluvio.operators import alert_rules as R
from pluvio.operators import decision as D
from pluvio.operators import growth as G
from pluvio.operators import warnings as W
from pluvio.plans import mass_queries as MQ
from pluvio.plans import sqltext as S
from pluvio.plans.decision_queries import TH, _threats
from pluvio.plans.fixtures import Scene
from pluvio.plans.grid_queries import PIN_SQL, samples, samples_sql
from pluvio.plans.registry import query
from pluvio.streaming import alerts

#: A timeline of seven steps for each threat: t, level, rate, unknown.
_STEPS = "select event_id, radar, will_hit, eta, level as cell, t, (cast(floor(chance / 7) as bigint) + t * (1 + event_id % 3)) % 5 as lv, (event_id + t) % 23 = 0 as unknown from (select *, 1704067200 + event_id % 3000 as radar from t) q, (select unnest([0, 15, 30, 45, 60, 75, 90]) as t) s"
LINES = f"{TH}, s as ({_STEPS})"


def _lines(s: Scene) -> DataFrame:
    steps = F.array(*[F.lit(t) for t in range(0, 91, 15)])
    e = F.col("event_id")

    def at(t: F.Column) -> F.Column:
        lv = ((F.floor(F.col("chance") / 7) + t * (1 + e % 3)) % 5).cast("int")
        return F.struct(t.alias("t"), lv.alias("level"), (lv * 2.0).alias("rate"), ((e + t) % 23 == 0).alias("unknown"))

    return s.threats().withColumn("timeline", F.transform(steps, at)).withColumn("radar", 1704067200 + e % 3000)


@query(f"with {LINES} select event_id, coalesce(min(t) filter (lv >= 3 and not unknown), case when bool_or(unknown) then any_value(case when will_hit and cell >= 3 then eta end) end) as eta from s group by event_id")
def eta_to_level(s: Scene) -> DataFrame:
    mass = F.when(F.col("will_hit") & (F.col("level") >= 3), F.col("eta"))
    return _lines(s).select("event_id", R.eta_to_level(F.col("timeline"), F.lit(3), mass).alias("eta"))


@query(f"with {LINES} select event_id, coalesce(max(lv) filter (t >= 15 and t <= 45 and not unknown), 0) as peak from s group by event_id")
def arriving_peak(s: Scene) -> DataFrame:
    return _lines(s).select("event_id", R.arriving_peak(F.col("timeline"), F.lit(15)).alias("peak"))


_AT = "strftime((timestamp '1970-01-01' + to_seconds(cast(radar + {x} * 60 as bigint))) at time zone 'UTC' at time zone 'Europe/Warsaw', '%H:%M')"


@query(f"""with {LINES}, w as (select event_id, any_value(radar) as radar, min(t) as a, max(t) as b, min(t) filter (lv > 0 and not unknown) as f, max(t) filter (lv > 0 and not unknown) as l from s group by event_id),
p as (select event_id, t as pk from (select event_id, t, row_number() over (partition by event_id order by lv desc, t) as rn from s where lv > 0 and not unknown) q where rn = 1)
select event_id, case when f is null then 'Brak opadu od ' || {_AT.format(x='a')} || ' do ' || {_AT.format(x='b')} else 'Opad od ' || {_AT.format(x='f')} || ' do ' || {_AT.format(x='l')} || ', najsilniej ok. ' || {_AT.format(x='pk')} end as words from w left join p using (event_id)""")
def timeline_summary(s: Scene) -> DataFrame:
    return _lines(s).select("event_id", R.timeline_words(F.col("timeline"), F.col("radar")).alias("words"))


_AGE = "(event_id % 50)"


@query(f"with {TH} select event_id, cast({_AGE} as double) as age, {_AGE} > 30 as stale from t")
def stale_gate(s: Scene) -> DataFrame:
    """Radar older than half an hour raises no alert and changes no memory."""
    now = F.lit(1704067200)
    age = R.age_min(now - F.col("event_id") % 50 * 60, now)
    return s.threats().select("event_id", age.alias("age"), (age > R.STALE_MIN).alias("stale"))


@query(f"with {TH} select event_id, cast(greatest(0, floor(eta - {_AGE} / 4e0 + 0.5e0)) as int) as wall_min, least(1, {_AGE} / 4e0 / 90) as cursor from t where eta is not null")
def wall_clock(s: Scene) -> DataFrame:
    age = F.col("event_id") % 50 / 4.0
    return s.threats().where("eta is not null").select("event_id", R.wall_clock(F.col("eta"), age).alias("wall_min"), F.least(F.lit(1.0), age / 90).alias("cursor"))


_SET = "select pin_id as user, event_id, 15 + 5 * (event_id % 7) as lead, 1 + event_id % 3 as lv, 10 * (event_id % 9) as ch from t"


@query(f"with {TH}, x as ({_SET}) select event_id, case when lead = 45 and lv = 1 and ch = 20 then 'czuly' when lead = 30 and lv = 2 and ch = 50 then 'normalny' when lead = 20 and lv = 3 and ch = 80 then 'pewne' end as preset from x")
def alert_presets(s: Scene) -> DataFrame:
    e = F.col("event_id")
    return s.threats().select("event_id", R.preset(15 + 5 * (e % 7), 1 + e % 3, 10 * (e % 9)).alias("preset"))


@query(f"with {TH} select event_id, cast(case when event_id % 11 = 0 then 30 else greatest(10, least(60, floor(nearest_km * 2 + 0.5e0))) end as int) as lead_min, cast(greatest(1, least(3, coalesce(pin_level, 2))) as int) as min_level, cast(least(90, chance) as int) as min_chance from t where nearest_km is not null")
def settings_sanitize(s: Scene) -> DataFrame:
    rows = s.threats().where("nearest_km is not null")
    lead = F.when(F.col("event_id") % 11 == 0, "dużo").otherwise((F.col("nearest_km") * 2).cast("string"))
    return rows.select("event_id", R.setting(lead, "lead_min").alias("lead_min"), R.setting(F.col("pin_level"), "min_level").alias("min_level"), R.setting(F.col("chance"), "min_chance").alias("min_chance"))


@query(f"with {TH}, d as (select pin_id, event_id % 40 as id, max(ts) as ts from t group by all), o as (select *, row_number() over (partition by pin_id order by ts desc, id) as place from d) select pin_id, id, place from o where place <= 12")
def alert_log_topk(s: Scene) -> DataFrame:
    """The twelve newest alerts of each pin, each id once."""
    one = s.threats().groupBy("pin_id", (F.col("event_id") % 40).alias("id")).agg(F.max("ts").alias("ts"))
    order = Window.partitionBy("pin_id").orderBy(F.desc("ts"), "id")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= R.LOG_MOST).select("pin_id", "id", "place")


@query(f"with {TH} select event_id, hour(ts) < 22 and hour(ts) >= 6 as notify, hour(ts) < 22 and hour(ts) >= 6 and event_id % 2 = 0 as sound from t")
def alert_delivery_flag(s: Scene) -> DataFrame:
    """In the quiet hours, here from 22 to 6, an alert is a banner alone."""
    loud = (F.hour("ts") < 22) & (F.hour("ts") >= 6)
    return s.threats().select("event_id", loud.alias("notify"), (loud & (F.col("event_id") % 2 == 0)).alias("sound"))


@query(f"with {TH}, b as (select event_id, event_id % 2 = 0 as av, event_id % 3 = 0 as png, event_id % 5 = 0 as er, event_id % 7 < 4 as fe, event_id % 11 < 3 as ph from t) select event_id, case when png and not ph then 'sri' when not av then 'tiles' when er then 'tiles' when fe and not ph and not png then 'tiles' else 'wait' end as shows from b")
def overlay_fallback(s: Scene) -> DataFrame:
    e = F.col("event_id")
    return s.threats().select("event_id", R.overlay_choice(e % 2 == 0, e % 3 == 0, e % 5 == 0, e % 7 < 4, e % 11 < 3).alias("shows"))


_WALL = "greatest(0, cast(floor(eta - event_id % 50 / 4e0 + 0.5e0) as int))"


@query(f"""with {TH} select event_id, case when eta = 0 then 'teraz' when eta is not null then case when {_WALL} = 0 then 'teraz' else {_WALL} || ' min' end when not will_hit and miss_km > 8 and nearest_km > 20 and nearest_km <= 80 then 'minie' else '—' end as eta_label,
case when nearest_km is null then 'brak' else cast(floor(nearest_km + 0.5e0) as bigint) || ' km' end as echo_label, case when nearest_km <= 8 and pin_level >= 2 then 'teraz' when eta > 0 and eta <= 25 and will_hit and expect_level >= 2 then 'zaraz' when will_hit and expect_level >= 2 then 'blisko' else 'czysto' end as chip from t""")
def threat_labels(s: Scene) -> DataFrame:
    level = D.threat_level(F.col("degree").isNotNull(), F.lit(False))
    eta = R.eta_label(F.col("eta"), F.col("event_id") % 50 / 4.0, F.col("will_hit"), F.col("miss_km"), F.col("nearest_km"))
    return _threats(s).select("event_id", eta.alias("eta_label"), R.echo_label(F.col("nearest_km")).alias("echo_label"), R.level_chip(level).alias("chip"))


@query("""select p_partkey, case when p_size % 5 = 4 then case when p_size % 2 = 0 then 'Gwałtowna burza' else 'Ulewa' end when p_size % 5 = 3 then case when p_size % 2 = 0 then 'Burza' else 'Ulewa i wiatr' end when p_size % 5 = 2 then 'Deszcz' when p_size % 5 = 1 then 'Słaby deszcz' else 'Opad' end as noun,
case when p_size % 2 = 0 and p_size % 5 >= 3 then 'Burza' when p_size % 5 >= 3 then 'Ulewa' else 'Deszcz' end as storm, case when p_partkey >= 1000 then substr(cast(p_partkey as varchar), 1, 4) end as code,
case p_partkey % 3 when 0 then '' when 1 then ' · powiat ' || p_brand else ' · Powiat ' || p_brand end as county from part""")
def copy_scalars(s: Scene) -> DataFrame:
    level, odd, k = F.col("p_size") % 5, F.col("p_size") % 2 == 0, F.col("p_partkey")
    county = F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.lit("Powiat "), F.col("p_brand")))
    return s.table("part").select("p_partkey", R.level_noun(level, odd).alias("noun"), D.storm_noun(level, odd).alias("storm"), W.county_code(F.concat(F.lit("nr "), k.cast("string"))).alias("code"), R.county_bit(county).alias("county"))


@query(f"""with {LINES}, r as (select event_id, min(t) filter (t > 0 and not unknown and lv >= 1) as wet, bool_or(unknown) as lost, max(lv) filter (not unknown) as top from s group by event_id)
select event_id, case when nearest_km <= 8 and pin_level >= 1 then 0 when wet is not null then wet when lost then eta end as eta, coalesce(nearest_km <= 8 and pin_level >= 1, false) or wet is not null or (lost and will_hit) as will_hit,
receding and not coalesce(nearest_km <= 8 and pin_level >= 1, false) and wet is null as receding, case when not coalesce(nearest_km <= 8 and pin_level >= 1, false) and wet is not null then greatest(level, top) else level end as cell_level from t join r using (event_id)""")
def eta_resolve(s: Scene) -> DataFrame:
    """What the timeline makes of the mass's own arrival: rain over the pin is now, then the first wet step; unknown steps leave the mass's word."""
    line = F.col("timeline")
    known = F.filter(line, lambda p: ~p["unknown"])
    wet = F.array_min(F.transform(F.filter(known, lambda p: (p["t"] > 0) & (p["level"] >= 1)), lambda p: p["t"]))
    rows = _lines(s).withColumns({"wet": wet, "lost": F.exists(line, lambda p: p["unknown"]), "top": F.array_max(F.transform(known, lambda p: p["level"])), "over": F.coalesce((F.col("nearest_km") <= 8) & (F.col("pin_level") >= 1), F.lit(False))})
    over, wets = F.col("over"), F.col("wet").isNotNull()
    return rows.select(
        "event_id", F.when(over, 0).when(wets, F.col("wet")).when(F.col("lost"), F.col("eta")).alias("eta"), (over | wets | (F.col("lost") & F.col("will_hit"))).alias("will_hit"),
        (F.col("receding") & ~over & ~wets).alias("receding"), F.when(~over & wets, F.greatest("level", "top")).otherwise(F.col("level")).alias("cell_level"),
    )


@query()
def alert_replay(s: Scene) -> DataFrame:
    """The events that each pin's trace of threats fires, with their words; every second threat has a timeline, every third pin settings of its own."""
    rows = _lines(s).withColumns({"timeline_advected": F.col("event_id") % 2 == 0, "label": F.when(F.col("pin_id") % 2 == 0, "Warszawa").otherwise("Dom"), "toward": F.when(F.col("event_id") % 3 == 0, "wschód")})
    return alerts.replay(rows.withColumns({"lead_min": F.when(F.col("pin_id") % 3 == 0, 45), "min_level": F.when(F.col("pin_id") % 3 == 0, 1)}).withColumnRenamed("level", "cell_level"))


@query("""with recursive c as (select user_id as client, ts, row_number() over (partition by user_id order by ts) as n from events),
w as (select client, n, ts, true as allowed, [ts] as recent from c where n = 1
 union all select c.client, c.n, c.ts, len(list_filter(recent, lambda t: c.ts - t < interval 2 hours)) < 2,
  case when len(list_filter(recent, lambda t: c.ts - t < interval 2 hours)) < 2 then list_append(list_filter(recent, lambda t: c.ts - t < interval 2 hours), c.ts) else list_filter(recent, lambda t: c.ts - t < interval 2 hours) end from w join c on c.client = w.client and c.n = w.n + 1)
select client, ts, allowed from w""")
def rate_limit(s: Scene) -> DataFrame:
    """Calls of each client: two allowed in any two hours."""
    found = alerts.rate_limited(s.table("events").select(F.col("user_id").alias("client"), "ts"), 2, 7200)
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _pairs(s: Scene) -> DataFrame:
    return G.matched_cells(MQ._trails(s), MQ._members(s))


@query()
def lagrangian_pairs(s: Scene) -> DataFrame:
    """Cells of each trail that are the same rain in consecutive frames, and how their rate changed."""
    return _pairs(s)


@query()
def lagrangian_growth(s: Scene) -> DataFrame:
    """The sum of these changes by trail, and the change of the mean a minute."""
    return G.growth(_pairs(s))


_CASES = (
    ("Idzie od zachodu, echo ok. 13 km od Dom. To ruch echa, nie pewność. Szansa ~50%. Komórka może urosnąć.", "To ruch echa, nie pewność. Komórka może urosnąć."), ("Opad jest nad Twoją pinezką teraz. Komórka może urosnąć.", "Komórka może urosnąć."),
    ("Echo ok. 8 km od Dom.", None), ("Raz. Dwa. Trzy. Cztery.", "Raz. Cztery."),
)
_SAID = " ".join(f"when {i} then {'null' if b is None else repr(b)}" for i, (_, b) in enumerate(_CASES))
_SHEET = f"with {TH}, x as (select *, 1704067200 + event_id * 60 as radar, event_id % 50 as age, event_id % 6 = 0 as down, event_id % 4 = 0 as now_, event_id % 3 = 0 as nol, event_id % 7 = 0 as off, event_id % 5 = 0 as lost from t)"
_CLOCK_AT = _AT.format(x="0")
_HELD = "case when not lost and age > 30 then ' · alert wstrzymany' else '' end"


@query(f"""{_SHEET} select event_id, case when lost and not down and not off then null when off then case when lost then 'Bez sieci' else 'Bez sieci · ostatni radar ' || {_CLOCK_AT} end || {_HELD}
 else case when lost then 'Radar ✕' else 'Radar ' || {_CLOCK_AT} || ' · ' || age || ' min' end || {_HELD} || ' · ' || case when now_ then 'IMGW ✕' else 'IMGW ✓' end || ' · ' || case when nol then 'wyładowania ✕' else 'wyładowania ✓' end end as status,
 case when lost and not down and not off then null when (not lost and age > 30) or (down and not off) then 'warn' else 'mute' end as tone,
 case when event_id % 8 = 0 then case when event_id % 16 = 0 then 'Skanuję radar…' else 'Brak danych' end when event_id % 8 = 1 then 'Czysto' else 'Burza' end as headline,
 case when event_id % 9 > 0 then 'Idzie od zachodu' || case when event_id % 2 = 0 then ' na wschód' else '' end || coalesce(' · echo ' || cast(floor(nearest_km + 0.5e0) as bigint) || ' km', '') end as way,
 {_CLOCK_AT} || ': ' || case when event_id % 5 = 0 then 'poza radarem' when event_id % 5 = 1 then 'sucho' else case event_id % 5 when 2 then 'słaby' when 3 then 'silny' else 'ulewny' end || ', ~' || case event_id % 5 when 2 then '0.5' when 3 then '4' else '12.5' end || ' mm/h' end as bar,
 case event_id % 3 when 0 then 'Komórka rośnie' when 1 then 'Komórka słabnie' end as trend, case event_id % {len(_CASES)} {_SAID} end as caveat, event_id % 6 = 0 or event_id % 4 = 0 as offline from x""")
def sheet_texts(s: Scene) -> DataFrame:
    """The texts of the sheet: status, headline, direction, a bar, the trend, what else is said, and whether the network is gone."""
    e = F.col("event_id")
    radar = F.when(e % 5 > 0, 1704067200 + e * 60)
    text, tone = R.status_row(radar, radar + e % 50 * 60, e % 6 == 0, e % 4 == 0, e % 3 == 0, e % 7 == 0)
    level = F.when(e % 8 > 0, F.when(e % 8 == 1, "watch").otherwise("now"))
    bar = R.bar_readout(F.lit(0), F.when(e % 5 == 1, 0).when(e % 5 == 2, 1).when(e % 5 == 3, 3).otherwise(4), F.when(e % 5 == 2, 0.5).when(e % 5 == 3, 4.0).otherwise(12.5), e % 5 == 0, 1704067200 + e * 60)
    said = F.element_at(F.array(*[F.lit(a) for a, _ in _CASES]), (e % len(_CASES) + 1).cast("int"))
    return s.threats().select(
        "event_id", text.alias("status"), tone.alias("tone"), R.headline(level, F.lit("Burza"), e % 16 == 0).alias("headline"), R.way_line(F.when(e % 9 > 0, "zachodu"), F.when(e % 2 == 0, "wschód"), F.col("nearest_km")).alias("way"), bar.alias("bar"),
        R.trend_line(F.when(e % 3 == 0, "growing").when(e % 3 == 1, "decaying")).alias("trend"), R.caveat(said).alias("caveat"), R.is_offline(F.when(e % 6 == 0, False), e % 4 == 0, F.lit("TypeError Failed to fetch")).alias("offline"),
    )


_DETAIL_AGE = "(event_id % 40 / 4e0)"


@query(f"""with {TH}, x as (select event_id, eta, 'Dojście nad Twoją pinezką: ok. ' || eta || ' min. Tor minie za ~' || eta || ' min. Szansa na ok. 45 min.' as d, greatest(0, cast(floor(eta - {_DETAIL_AGE} + 0.5e0) as int)) as wall, event_id % 40 / 4e0 as age, 1704067200 + event_id * 60 as radar from t)
select event_id, case when eta is null or eta = 0 or wall = eta then d when wall = 0 then 'Dojście nad Twoją pinezką: teraz. Tor minie teraz. Szansa na ok. 45 min.' else 'Dojście nad Twoją pinezką: ok. ' || wall || ' min. Tor minie za ~' || wall || ' min. Szansa na ok. 45 min.' end as detail,
case event_id % 3 when 2 then 'Radar ' || {_AT.format(x='0')} || ' · poprzednia klatka' else case event_id % 3 when 0 then 'Radar IMGW ' else 'Radar ' end || {_AT.format(x='0')} || ' · sprzed ' || cast(floor(age + 0.5e0) as bigint) || ' min' end as caption,
case event_id % 5 when 0 then 'słaby deszcz' when 1 then 'słaby deszcz' when 2 then 'deszcz' else 'ulewa / burza' end as setting, 'test:' || event_id as trial from x""")
def alert_texts(s: Scene) -> DataFrame:
    """Arrival counted from now in a text, the radar's caption, the name of a class in settings, and the trial event."""
    e, eta = F.col("event_id"), F.col("eta").cast("string")
    rows = s.threats().select("event_id", "eta", F.concat(F.lit("Dojście nad Twoją pinezką: ok. "), eta, F.lit(" min. Tor minie za ~"), eta, F.lit(" min. Szansa na ok. 45 min.")).alias("d"), (e % 40 / 4.0).alias("age"), (1704067200 + e * 60).alias("radar"))
    source = F.when(e % 3 == 0, "sri").when(e % 3 == 1, "rainviewer").otherwise("placeholder")
    return rows.select("event_id", R.arrival_from_now(F.col("d"), F.col("eta"), F.col("age")).alias("detail"), R.age_caption(F.col("radar"), F.col("radar") + F.col("age") * 60, source).alias("caption"), R.level_setting(e % 5).alias("setting"), R.trial_event(F.lit("Dom"), e)["event_id"].alias("trial"))


@query(f"""with {samples_sql(peaked=True)}, p as ({PIN_SQL}), last as (select * from samples where frame_time = (select max(frame_time) from samples)) select pin_id, s.lat, s.lon, t from p cross join last s cross join (select unnest([30, 60, 90]) as t) k
where {S.km('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 108 and {S.km(*S.dest('s.lat', 's.lon', '70e0', '(40e0 * t / 60e0)'), 'p.lat', 'p.lon')} <= 30""")
def sample_arrives(s: Scene) -> DataFrame:
    """Samples within 108 km that a motion of 40 km/h toward 70 degrees brings to within 30 km of a pin."""
    from pluvio.operators.pins import newest, within

    near = within(newest(samples(s, peaked=True)), s.pins().select("pin_id", "lat", "lon"), 108.0).withColumn("t", F.explode(F.array(F.lit(30), F.lit(60), F.lit(90))))
    to = geo.destination("s_lat", "s_lon", 70.0, F.lit(40.0) * F.col("t") / 60.0)
    return near.where(geo.haversine(*to, "lat", "lon") <= 30).select("pin_id", F.col("s_lat").alias("lat"), F.col("s_lon").alias("lon"), "t")


@query("""with o as (select event_id, epoch(ts) as at from events where event_type = 'view'), p as (select event_id as path_id, epoch(ts) as at from events where event_type = 'click'),
r as (select o.event_id, p.path_id, row_number() over (partition by o.event_id order by p.at, p.path_id) as rn from o join p on abs(p.at - o.at) < 360) select event_id, path_id from r where rn = 1""")
def asof_overlay(s: Scene) -> DataFrame:
    """For each overlay the first tile frame less than six minutes away.

    That is the first one later than six minutes before the overlay. Both sides lie in slots of six
    minutes by these times, each slot also with the first frame of the next two, and a window from
    the latest backwards has for each overlay the frame that follows it. Each row goes there once,
    however many overlays and frames are close.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = s.table("events").select("event_id", "event_type", at.alias("at")).where("at is not null")
    slot = F.floor(F.col("at") / 360).alias("slot")
    frame = F.struct("at", F.col("event_id").isNull().alias("none"), F.col("event_id").alias("path_id")).alias("frame")
    frames = rows.where("event_type = 'click'").select(slot, frame)
    later = frames.groupBy("slot").agg(F.min("frame").alias("frame")).select(F.explode(F.array(F.col("slot") - 1, F.col("slot") - 2)).alias("slot"), "frame")
    known = frames.unionByName(later).select("slot", F.col("frame.at").alias("at"), "frame")
    overlays = rows.where("event_type = 'view'").select("event_id", F.col("at").alias("own"), (F.col("at") - 360).alias("at")).withColumn("slot", slot)
    both = overlays.unionByName(known, allowMissingColumns=True)
    back = Window.partitionBy("slot").orderBy(F.desc("at"), F.col("frame").isNotNull(), F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("next", F.last("frame", ignorenulls=True).over(back)).where("own is not null and next.at - own < 360")
    return near.groupBy("event_id").agg(F.min("next")["path_id"].alias("path_id"))
