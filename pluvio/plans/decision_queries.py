"""Chances, levels and words for a pin; verification; warnings and lightning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions import geo
from pluvio.functions.const import CHANCES, CITIES, FROM_PL, LEADS, TOWARD_PL
from pluvio.operators import decision as D
from pluvio.operators import verify as V
from pluvio.operators import warnings as W
from pluvio.operators.stages import written
from pluvio.plans import sqltext as S
from pluvio.plans.fixtures import PINS, SKILL, STRIKES, THREATS, WARNINGS, Scene
from pluvio.plans.grid_queries import samples, samples_sql
from pluvio.plans.registry import query

PIN_SQL = PINS.format(nation="nation")
TH = f"""t0 as ({THREATS.format(events='events')}), t as (select *, greatest(pin_level, case when coalesce(nearest_km <= 8, false) then 0 else greatest(case when will_hit or approaching then level else 0 end, case when will_hit then level else 0 end) end) as expect_level from t0)"""
_RAISES = """select event_id, 10 as raw, 0 as o, 'echoFar' as rung from t union all select event_id, 15 + greatest(degree, 1) * 10, 1, 'imgwWatch' from t where degree is not null
 union all select event_id, 60, 2, 'willHitApproachingKlasa2' from t where will_hit and approaching and expect_level >= 2 union all select event_id, 70, 3, 'overPinKlasa2' from t where nearest_km <= 8 and pin_level >= 2
 union all select event_id, 80, 4, 'overPinNowKlasa2' from t where eta = 0 and pin_level >= 2 union all select event_id, 70, 5, 'willHitEtaLe20' from t where eta > 0 and eta <= 20 and will_hit
 union all select event_id, 50, 6, 'willHitEta20to45' from t where eta > 20 and eta <= 45 and will_hit union all select event_id, 90, 7, 'overPinKlasa3' from t where nearest_km <= 5 and pin_level >= 3"""
LADDER = f"""with {TH}, r as ({_RAISES}), top as (select event_id, raw, rung from (select *, row_number() over (partition by event_id order by raw desc, o) as rn from r) q where rn = 1),
c1 as (select t.*, case when receding and (nearest_km is null or nearest_km > 8) and raw > 20 then 20 else raw end as raw1, case when receding and (nearest_km is null or nearest_km > 8) and raw > 20 then 'receding' else rung end as rung1 from t join top using (event_id)),
c2 as (select *, coalesce(miss_km > 13 and not will_hit and greatest(15, raw1 - 20) < raw1, false) as beside from c1),
c3 as (select *, case when beside then 'missBeside' else rung1 end as rung, case when beside then greatest(15, raw1 - 20) else raw1 end as raw from c2),
ship(rung, shipped) as (values {', '.join(f"('{a}', {b})" for a, b in CHANCES)}),
ladder as (select *, greatest(5, least(95, cast(floor(raw / 5e0 + 0.5e0) * 5 as bigint))) as raw_pct, case when nearest_km <= 100 then shipped else greatest(5, least(95, cast(floor(raw / 5e0 + 0.5e0) * 5 as bigint))) end as pct from c3 join ship using (rung))"""


def _threats(s: Scene) -> DataFrame:
    return s.threats().withColumn("expect_level", D.expect_level(F.col("level"), F.col("level")))


@query(f"{LADDER} select event_id, rung, raw_pct, pct as chance_pct from ladder")
def chance_ladder(s: Scene) -> DataFrame:
    rung, raw = D.chance_ladder()
    return _threats(s).select("event_id", rung.alias("rung"), D.rounded_chance(raw).alias("raw_pct"), D.chance().alias("chance_pct"))


@query(f"select rung, shipped from (values {', '.join(f'''('{a}', {b})''' for a, b in CHANCES)}) v(rung, shipped)")
def chance_rung_lookup(s: Scene) -> DataFrame:
    rungs = s.spark.createDataFrame([(a,) for a, _ in CHANCES], "rung string")
    return rungs.select("rung", D.calibrated(F.col("rung")).alias("shipped"))


@query(f"with {TH} select event_id, expect_level from t")
def expect_level(s: Scene) -> DataFrame:
    return _threats(s).select("event_id", "expect_level")


_LEVEL = "case when nearest_km <= 8 and pin_level >= 2 then 'now' when eta > 0 and eta <= 25 and will_hit and expect_level >= 2 then 'imminent' when will_hit and expect_level >= 2 then 'nearby' when degree is not null then 'watch' else 'clear' end"


@query(f"with {TH} select event_id, {_LEVEL} as threat_level from t")
def threat_level(s: Scene) -> DataFrame:
    return _threats(s).select("event_id", D.threat_level(F.col("degree").isNotNull(), F.lit(False)).alias("threat_level"))


_NOUN = "case when event_id % 2 = 0 and {x} >= 3 then 'Burza' when {x} >= 3 then 'Ulewa' else 'Deszcz' end"


@query(f"""with {TH}, l as (select *, {_LEVEL} as lv from t) select event_id, case lv when 'now' then {_NOUN.format(x='greatest(pin_level, 2)')} || ' nad Tobą' when 'imminent' then {_NOUN.format(x='expect_level')} || ' nadciąga'
 when 'nearby' then case when receding then 'Opad oddala się' when approaching and not coalesce(eta = 0, false) then 'Opad nadciąga' else 'Opad w okolicy' end when 'watch' then 'Ostrzeżenie IMGW' else 'Czysto' end as title,
 case when expect_level >= 4 then case when event_id % 3 = 0 then 'silnej ulewy, porywów wiatru, możliwego gradu' else 'silnej ulewy, porywów wiatru' end when expect_level >= 3 then 'ulewy i porywistego wiatru' when expect_level >= 2 then 'deszczu i mokrej jezdni' when expect_level >= 1 then 'słabego deszczu' end as expect from l""")
def threat_copy(s: Scene) -> DataFrame:
    level = D.threat_level(F.col("degree").isNotNull(), F.lit(False))
    return _threats(s).select("event_id", D.title(level, F.col("event_id") % 2 == 0).alias("title"), D.expect_words(F.col("expect_level"), F.col("event_id") % 3 == 0).alias("expect"))


_FROM = S.pick(FROM_PL, "event_id % 8")
_TOWARD = S.pick(TOWARD_PL, "event_id % 8")
_ROUND = "cast(floor({x} + 0.5e0) as bigint)"
_NOTE = "Komórka może też urosnąć na miejscu — tego radar nie zapowie."
_DIST = f"(case when nearest_km is not null then 'ok. ' || {_ROUND.format(x='nearest_km')} || ' km od ' || label else 'w okolicy ' || label end)"


@query(f"""with {TH}, a as (select *, coalesce(nearest_km <= 80, false) or will_hit or (approaching and coalesce(miss_km <= 20, false)) as about, case when event_id % 3 = 0 then 'Kraków' else 'Dom' end as label, case when event_id % 3 = 0 then 'nad Krakowem' else 'nad Twoją pinezką' end as above, event_id % 60 as speed, case when event_id % 4 = 0 then 'Uwaga.' end as body, {_LEVEL} as lv from t),
l as (select *, case when event_id % 5 < 4 and about then {_FROM} end as came, case when event_id % 5 < 4 and about then {_TOWARD} end as gone from a)
select event_id, about, case when about or level >= 1 or will_hit then case when expect_level >= 4 then 'silnej ulewy, porywów wiatru, możliwego gradu' when expect_level >= 3 then 'ulewy i porywistego wiatru' when expect_level >= 2 then 'deszczu i mokrej jezdni' when expect_level >= 1 then 'słabego deszczu' end end as expect,
case when eta = 0 and (pin_level >= 1 or coalesce(nearest_km <= 5, false)) then 'Opad jest ' || above || ' teraz. {_NOTE}'
 when receding and about then coalesce('Idzie od ' || came, 'Komórka') || ' (' || {_DIST} || ') i odchodzi na ' || coalesce(gone, 'bok') || '. Szansa ~' || chance || '%. {_NOTE}'
 when will_hit and came is not null then 'Idzie od ' || came || case when speed > 0 then ' (~' || speed || ' km/h)' else '' end || ', echo ' || {_DIST} || '.' || case when eta > 0 then ' Dojście ' || above || ': ok. ' || eta || ' min.' else '' end || ' Szansa ~' || chance || '%. To ruch echa, nie pewność. {_NOTE}'
 when came is not null and miss_km > 5 and (nearest_km is null or nearest_km > 8) then 'Idzie od ' || came || ', echo ' || {_DIST} || '. Tor minie ' || label || ' ok. ' || {_ROUND.format(x='miss_km')} || ' km obok' || case when eta > 0 then ' za ~' || eta || ' min' else '' end || '. Nad samym punktem szansa ~' || chance || '%. {_NOTE}'
 when nearest_km is not null then 'Echo ' || {_DIST} || coalesce(', od ' || came, '') || '. Szansa ~' || chance || '%. {_NOTE}'
 when lv = 'watch' then coalesce(body, 'Instytut wydał ostrzeżenie dla powiatu.') || ' Dla ' || label || ' szansa z radaru ~' || chance || '% na ~45 min.'
 when lv = 'clear' then upper(above[1]) || above[2:] || ' radar nie widzi groźnej komórki w promieniu 100 km. Szansa ~' || chance || '% na ok. 45 min. {_NOTE}'
 else 'Szansa ~' || chance || '% dla ' || label || '. {_NOTE}' end as detail from l""")
def threat_detail(s: Scene) -> DataFrame:
    """Whether a threat is about the pin, what to expect of it, hail included, and the text under its headline."""
    e = F.col("event_id")
    some = lambda names: F.when((e % 5 < 4) & F.col("about"), F.element_at(F.array(*map(F.lit, names)), (e % 8 + 1).cast("int")))
    rows = _threats(s).withColumns({"label": F.when(e % 3 == 0, "Kraków").otherwise("Dom"), "speed_kmh": (e % 60).cast("double"), "body": F.when(e % 4 == 0, "Uwaga."), "about": D.about_pin()})
    rows = rows.withColumns({"coming_from": some(FROM_PL), "toward": some(TOWARD_PL), "max_level": F.col("level"), "level": D.threat_level(F.col("degree").isNotNull(), F.lit(False))})
    expect = F.when(F.col("about") | (F.col("max_level") >= 1) | F.col("will_hit"), D.expect_words(F.col("expect_level"), F.lit(True)))
    return rows.select("event_id", "about", expect.alias("expect"), D.detail().alias("detail"))


@query(f"with {TH} select user, event_id, chance, lv, cast(hh as double) as hour, case when q0 = q1 then false when q0 < q1 then hh >= q0 and hh < q1 else hh >= q0 or hh < q1 end as quiet from (select pin_id as user, event_id, chance, level as lv, hour(ts) + minute(ts) / 60e0 as hh, pin_id % 24 as q0, (pin_id * 7) % 24 as q1 from t) q")
def quiet_hours(s: Scene) -> DataFrame:
    """Whether an alert falls into the user's quiet hours, which may pass midnight; equal bounds turn them off."""
    rows = s.threats().select(F.col("pin_id").alias("user"), "event_id", "chance", F.col("level").alias("lv"), (F.hour("ts") + F.minute("ts") / 60.0).alias("hour"), (F.col("pin_id") % 24).alias("q0"), (F.col("pin_id") * 7 % 24).alias("q1"))
    h, a, b = F.col("hour"), F.col("q0"), F.col("q1")
    return rows.select("user", "event_id", "chance", "lv", "hour", F.when(a == b, False).when(a < b, (h >= a) & (h < b)).otherwise((h >= a) | (h < b)).alias("quiet"))


SK = f"f as ({SKILL.format(lineitem='lineitem')})"
_COUNTS = "count(*) filter (pred and obs) as hit, count(*) filter (not pred and obs) as miss, count(*) filter (pred and not obs) as fa, count(*) filter (not pred and not obs) as cn"
_RATES = "hit / greatest(1, hit + miss) as pod, fa / greatest(1, hit + fa) as far, hit / greatest(1, hit + miss + fa) as csi"


@query(f"with {SK}, c as (select lead, {_COUNTS} from f group by lead) select *, {_RATES} from c")
def skill_scores(s: Scene) -> DataFrame:
    return V.skill(s.skill(), "lead")


@query(f"""with {SK}, c as (select {_COUNTS} from f) select '{{"hit":' || hit || ',"miss":' || miss || ',"fa":' || fa || ',"cn":' || cn || '}}' as report from c""")
def skill_report(s: Scene) -> DataFrame:
    return V.skill(s.skill()).select(F.to_json(F.struct("hit", "miss", "fa", "cn")).alias("report"))


@query(f"with {SK}, b as (select lead, list_sort(list(chance - 40)) as v from f group by lead) select lead, v[cast(floor(len(v) * 0.1e0) as bigint) + 1] as p10, v[cast(floor(len(v) * 0.5e0) as bigint) + 1] as p50, v[cast(floor(len(v) * 0.9e0) as bigint) + 1] as p90 from b")
def eta_bias_percentiles(s: Scene) -> DataFrame:
    """Of the bias of each lead."""
    return V.bias_percentiles(s.skill().withColumn("bias", F.col("chance") - 40), "lead").drop("n_bias")


_BUCKETS = ", ".join(f"({a}, {b})" for a, b in V.BUCKETS)


@query(f"with {SK}, b(low, high) as (values {_BUCKETS}) select low, high, count(chance) as n, {S.half_up('avg(chance)', 6)} as mean, {S.half_up('avg(cast(obs as int))', 6)} as observed from b left join f on chance between low and high group by low, high")
def chance_calibration(s: Scene) -> DataFrame:
    found = V.calibration(s.skill())
    return found.select("low", "high", "n", geo.half_up(F.col("mean"), 6).alias("mean"), geo.half_up(F.col("observed"), 6).alias("observed"))


_KIND = "case when event_id % 3 = 0 then 'advected' when will_hit and eta > 0 then 'crude' else 'persist' end"


@query(f"with {TH}, k as (select {_KIND} as kind, nearest_km is not null as near from t), n as (select count(*) as n_all, count(*) filter (near) as n_echo, count(*) filter (near and kind = 'advected') as a, count(*) filter (near and kind = 'crude') as c, count(*) filter (near and kind = 'persist') as p from k) select n_all, n_echo, 100e0 * a / greatest(1, n_echo) as advected, 100e0 * c / greatest(1, n_echo) as crude, 100e0 * p / greatest(1, n_echo) as persist from n")
def motion_mix(s: Scene) -> DataFrame:
    """By what the motion of threats with echo within 100 km was found; here every third has a timeline that moves."""
    return V.motion_mix(s.threats().withColumn("timeline_advected", F.col("event_id") % 3 == 0))


_KM = S.km("s.lat", "s.lon", "p.lat", "p.lon")
OBS = f"""with {samples_sql(frames=24, peaked=True)}, p as ({PIN_SQL}), every as (select distinct frame_time from samples), fr as (select frame_time from (select frame_time, row_number() over (order by frame_time) as place, max(frame_time) over () as final from every) z where place >= 4 and frame_time + 3600 <= final), tt as (select a.frame_time, lead, b.frame_time as valid from fr a, (select unnest([10, 20, 30, 40, 50, 60]) as lead) l join every b on b.frame_time = a.frame_time + lead * 60),
obs as (select pin_id, tt.frame_time, lead, coalesce(max(level), 0) as obs from tt cross join p left join samples s on s.frame_time = valid and {_KM} <= 8 group by all)"""


def _observed(s: Scene) -> DataFrame:
    return V.observed_at_leads(written(samples(s, frames=24, peaked=True)), s.pins(), LEADS)


@query(f"{OBS} select * from obs")
def obs_at_lead(s: Scene) -> DataFrame:
    return _observed(s)


@query(f"{OBS} select pin_id, frame_time, min(lead) filter (obs >= 1) as first_lead from obs group by all")
def first_obs_lead(s: Scene) -> DataFrame:
    return _observed(s).groupBy("pin_id", "frame_time").agg(F.min(F.when(F.col("obs") >= 1, F.col("lead"))).alias("first_lead"))


@query(f"with {samples_sql(frames=24, peaked=True)}, n as (select frame_time, count(*) as n from samples group by all) select frame_time, list(frame_time) over w as history, sum(n) over w as samples from n window w as (order by frame_time rows between 3 preceding and current row)")
def rolling_history(s: Scene) -> DataFrame:
    """Each frame with the three before it."""
    w = Window.orderBy("frame_time").rowsBetween(-3, 0)  # one row a frame
    counts = samples(s, frames=24, peaked=True).groupBy("frame_time").agg(F.count("*").alias("n"))
    return counts.select("frame_time", F.collect_list("frame_time").over(w).alias("history"), F.sum("n").over(w).alias("samples"))


@query(f"""{OBS}, now as (select pin_id, fr.frame_time, {S.level(f'coalesce(avg(rate) filter ({_KM} <= 8), 0)')} as lv from fr cross join p join samples s on s.frame_time = fr.frame_time and {_KM} <= 100 group by pin_id, fr.frame_time),
f as (select lead, lv >= thr as pred, obs >= thr as obs, thr from obs join now using (pin_id, frame_time), (select unnest([1, 2]) as thr) h), c as (select thr, lead, {_COUNTS} from f group by thr, lead) select *, {_RATES} from c""")
def hindcast_persistence(s: Scene) -> DataFrame:
    """Skill of the class at the pin, taken to last, for pins with echo within 100 km."""
    from pluvio.operators.pins import neighbourhood

    wet = written(samples(s, frames=24, peaked=True))
    now = neighbourhood(wet, s.pins()).where("nearest_km is not null").select("pin_id", "frame_time", F.col("pin_level").alias("lv"))
    facts = V.observed_at_leads(wet, s.pins(), LEADS).join(now, ["pin_id", "frame_time"]).withColumn("thr", F.explode(F.array(F.lit(1), F.lit(2))))
    return V.skill(facts.select("thr", "lead", (F.col("lv") >= F.col("thr")).alias("pred"), (F.col("obs") >= F.col("thr")).alias("obs")), "thr", "lead")


WARN = f"w0 as ({WARNINGS.format(orders='orders')}), w as (select *, starts + interval 8 hour as ends, contains(lower(event), 'burz') or contains(lower(event), 'grad') or contains(lower(event), 'silny deszcz') as storm from w0)"
NOW = "timestamp '1996-06-01 12:00:00'"


def _warnings(s: Scene) -> DataFrame:
    return s.warnings().withColumns({"ends": F.col("starts") + F.expr("interval 8 hours"), "storm": W.storm_related(F.col("event")), "teryt": F.array("code_a", "code_b")})


@query(f"with {WARN} select id, degree, case when contains(lower(event), 'burz') then 'burze' when contains(lower(event), 'grad') then 'grad' when contains(lower(event), 'deszcz') then 'deszcz' else lower(event) end as short, storm from w")
def warnings_normalize(s: Scene) -> DataFrame:
    return _warnings(s).select("id", "degree", W.short_event(F.col("event")).alias("short"), "storm")


@query(f"with {WARN} select id, starts - interval 30 minute <= {NOW} and {NOW} <= ends as active, {NOW} <= ends as live from w")
def warnings_active(s: Scene) -> DataFrame:
    now = F.expr(NOW)
    return _warnings(s).select("id", W.is_active(F.col("starts"), F.col("ends"), now).alias("active"), W.is_live(F.col("ends"), now).alias("live"))


@query(f"with {WARN} select id, code_a = '0205' or code_b = '0205' as matches from w")
def warning_match(s: Scene) -> DataFrame:
    return _warnings(s).select("id", F.array_contains("teryt", "0205").alias("matches"))


@query(f"with {WARN} select id, place from (select id, row_number() over (order by (code_a = '0205' or code_b = '0205') desc, id) as place from w where (code_a = '0205' or code_b = '0205') or storm) q where place <= 40")
def warnings_select(s: Scene) -> DataFrame:
    """The place's own warnings first, then other storms; 40 at most."""
    rows = _warnings(s).withColumn("own", F.array_contains("teryt", "0205")).where("own or storm").orderBy(F.desc("own"), "id").limit(40)
    return rows.select("id", F.row_number().over(Window.orderBy(F.desc("own"), "id")).alias("place"))


@query(f"with {WARN} select teryt, max(degree) as degree from (select code_a as teryt, degree, ends, storm from w union all select code_b, degree, ends, storm from w) q where storm and {NOW} <= ends group by teryt")
def warning_degrees(s: Scene) -> DataFrame:
    return W.degrees_by_county(_warnings(s).where(F.col("storm") & W.is_live(F.col("ends"), F.expr(NOW))))


@query(f"""with {WARN}, p as (select pin_id, lpad(cast(pin_id + 200 as varchar), 4, '0') as terc, label from ({PIN_SQL}) q), l as (select pin_id, terc, label, id, event, row_number() over (partition by pin_id order by id) as rn from p join w on storm and (code_a = terc or code_b = terc) and {NOW} <= ends)
select pin_id, id, 'Ostrzeżenie IMGW: ' || case when contains(lower(event), 'burz') then 'burze' when contains(lower(event), 'grad') then 'grad' when contains(lower(event), 'deszcz') then 'deszcz' else lower(event) end || ' · powiat ' || lower(label) as lane from l where rn = 1""")
def warning_lane(s: Scene) -> DataFrame:
    """The line about the first live storm warning of each pin's county; ids are in the feed's order."""
    pins = s.pins().select("pin_id", F.lpad((F.col("pin_id") + 200).cast("string"), 4, "0").alias("terc"), F.lower("label").alias("county"))
    return W.lanes(pins, _warnings(s).withColumn("ordinal", F.col("id")), F.expr(NOW))


_WORD = "(case {d} when 0 then 'dziś' when 1 then 'jutro' end)"
_WHEN = "(['niedz.', 'pon.', 'wt.', 'śr.', 'czw.', 'pt.', 'sob.'][dayofweek({t}) + 1] || ', ' || day({t}) || ' ' || ['sty', 'lut', 'mar', 'kwi', 'maj', 'cze', 'lip', 'sie', 'wrz', 'paź', 'lis', 'gru'][month({t})] || ', ' || strftime({t}, '%H:%M'))"
_STARTS, _ENDS = "(date_trunc('day', o_orderdate) + interval 9 hour + to_hours(cast(24 * (o_orderkey % 3) as bigint)))", "(date_trunc('day', o_orderdate) + interval 21 hour + to_hours(cast(24 * (o_orderkey % 4) as bigint)))"


@query(f"""with r as (select o_orderkey, {_STARTS} as a, {_ENDS} as b, o_orderkey % 3 as d0, o_orderkey % 4 as d1 from orders) select o_orderkey, case when o_orderkey % 10 = 0 then 'wkrótce – ' || {_WHEN.format(t='b')} when d0 < 2 and d0 = d1 then {_WORD.format(d='d0')} || ' 09:00–21:00'
 when d0 < 2 and d1 < 2 then {_WORD.format(d='d0')} || ' 09:00 – ' || {_WORD.format(d='d1')} || ' 21:00' else {_WHEN.format(t='a')} || ' – ' || {_WHEN.format(t='b')} end as words from r""")
def warning_ranges(s: Scene) -> DataFrame:
    """From when to when warnings hold, as said on the day of the order at noon."""
    k, day = F.col("o_orderkey"), F.date_trunc("day", "o_orderdate")
    text = lambda hour, n: F.date_format(day + F.make_dt_interval(n.cast("int"), F.lit(hour)), "yyyy-MM-dd HH:mm:ss")
    starts = F.when(k % 10 == 0, "wkrótce").otherwise(text(9, k % 3))
    return s.table("orders").select("o_orderkey", W.warning_range(starts, text(21, k % 4), day + F.expr("interval 11 hours")).alias("words"))


@query("select o_orderkey, (case when o_orderkey % 10 = 0 then null else o_orderdate at time zone 'Europe/Warsaw' end) at time zone 'UTC' as utc from orders")
def warsaw_time(s: Scene) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 10 == 0, "bez terminu").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return s.table("orders").select("o_orderkey", W.warsaw(raw).cast("timestamp_ntz").alias("utc"))


STR = f"k as ({STRIKES.format(events='events')})"
_CLOCK = "timestamp '2024-01-15 12:00:00'"


@query(f"with {STR} select strike_id from k where ts >= (select max(ts) from k) - interval 15 minute")
def strike_window(s: Scene) -> DataFrame:
    """Strikes of the last quarter of an hour before the newest one."""
    strikes = s.strikes()
    newest = F.broadcast(strikes.agg(F.max("ts").alias("now")))  # one row
    return strikes.join(newest, F.col("ts") >= F.col("now") - F.expr("interval 15 minutes")).select("strike_id")


@query(f"with {STR}, a as (select strike_id, (epoch({_CLOCK}) - epoch(ts)) / 60e0 as age from k) select strike_id, {S.half_up('case when age < 0 then 0.95e0 when age > 15 then 0 else 0.95e0 - 0.8e0 * age / 15 end', 6)} as opacity from a")
def strike_opacity(s: Scene) -> DataFrame:
    age = (F.unix_micros(F.expr(_CLOCK)) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60e6
    return s.strikes().select("strike_id", geo.half_up(W.opacity(age), 6).alias("opacity"))


_AGE = f"(epoch({_CLOCK}) - epoch(ts)) / 60e0"
_FADED = f"(case when {_AGE} < 0 then 0.95e0 when {_AGE} > 15 then 0e0 else 0.95e0 - 0.8e0 * {_AGE} / 15 end)"


@query(f"with {STR} select strike_id, {S.half_up(_FADED, 6)} as opacity, {S.half_up('lon', 3)} as lon, {S.half_up('lat', 3)} as lat from k where {_FADED} > 0")
def strike_features(s: Scene) -> DataFrame:
    """Strikes that have not faded, as features; here read back from their JSON."""
    read = F.from_json("feature", "type string, properties struct<opacity:double>, geometry struct<type:string,coordinates:array<double>>")
    found = W.strike_features(s.strikes(), F.expr(_CLOCK).cast("timestamp")).withColumn("f", read).where("f.type = 'Feature' and f.geometry.type = 'Point'")
    return found.select("strike_id", geo.half_up(F.col("f.properties.opacity"), 6).alias("opacity"), geo.half_up(F.element_at("f.geometry.coordinates", 1), 3).alias("lon"), geo.half_up(F.element_at("f.geometry.coordinates", 2), 3).alias("lat"))


@query(f"with {STR} select distinct ts, lat, lon from k where strike_id % 3 < 2 union select distinct ts, lat, lon from k where strike_id % 3 > 0")
def strike_union(s: Scene) -> DataFrame:
    """Strikes of overlapping files, each once."""
    k = s.strikes()
    return k.where("strike_id % 3 < 2").unionByName(k.where("strike_id % 3 > 0")).select("ts", "lat", "lon").distinct()


_SQ = f"sq as (select pin_id as k, lat, lon, lpad(cast(200 + pin_id as varchar), 4, '0') as code from ({PIN_SQL}) p), pt as (select event_id as pin_id, 48.4e0 + (event_id % 67) * 0.097e0 as lat, 13.9e0 + (event_id % 103) * 0.1e0 as lon from events)"


def _squares(s: Scene) -> DataFrame:
    """A box of 1.2 by 2 degrees around each pin, with a hole in every second; as edges of rings."""
    p = s.pins()
    ring = lambda n, h, w: F.array(*[F.struct(F.lit(n).alias("ring"), (F.col("lon") + a * w).alias("x1"), (F.col("lat") + b * h).alias("y1"), (F.col("lon") + c * w).alias("x2"), (F.col("lat") + d * h).alias("y2")) for a, b, c, d in ((-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1))])
    edges = F.when(F.col("pin_id") % 2 == 1, F.concat(ring(0, 0.6, 1.0), ring(1, 0.2, 0.3))).otherwise(ring(0, 0.6, 1.0))
    box = {"min_x": F.col("lon") - 1.0, "max_x": F.col("lon") + 1.0, "min_y": F.col("lat") - 0.6, "max_y": F.col("lat") + 0.6, "code": F.lpad((F.col("pin_id") + 200).cast("string"), 4, "0")}
    return p.withColumns(box).select("code", "min_x", "min_y", "max_x", "max_y", F.inline(edges))


def _points(s: Scene) -> DataFrame:
    at = F.col("event_id")
    return s.table("events").select(at.alias("pin_id"), (48.4 + at % 67 * F.lit(0.097)).alias("lat"), (13.9 + at % 103 * F.lit(0.1)).alias("lon"))


@query(f"with {_SQ} select pin_id, min(code) as code from pt join sq on pt.lon >= sq.lon - 1 and pt.lon < sq.lon + 1 and pt.lat >= sq.lat - 0.6e0 and pt.lat < sq.lat + 0.6e0 and not (k % 2 = 1 and pt.lon >= sq.lon - 0.3e0 and pt.lon < sq.lon + 0.3e0 and pt.lat >= sq.lat - 0.2e0 and pt.lat < sq.lat + 0.2e0) group by pin_id")
def pip_lookup(s: Scene) -> DataFrame:
    return W.in_polygon(_points(s), _squares(s))


_CITY = ", ".join(f"({i}, {a!r}, {b!r}, '{t}')" for i, (a, b, _, _, t) in enumerate(CITIES))
_CK = S.km("pt.lat", "pt.lon", "c.lat", "c.lon")


@query(f"""with {_SQ}, c(place, lat, lon, terc) as (values {_CITY}), n as (select pin_id, terc, row_number() over (partition by pin_id order by {_CK}, place desc) as rn from pt join c on {_CK} <= 30),
i as (select pin_id, min(code) as code from pt join sq on pt.lon >= sq.lon - 1 and pt.lon < sq.lon + 1 and pt.lat >= sq.lat - 0.6e0 and pt.lat < sq.lat + 0.6e0 and not (k % 2 = 1 and pt.lon >= sq.lon - 0.3e0 and pt.lon < sq.lon + 0.3e0 and pt.lat >= sq.lat - 0.2e0 and pt.lat < sq.lat + 0.2e0) group by pin_id)
select pt.pin_id, coalesce(case when pt.pin_id % 10 = 0 then '9999' end, code, terc) as terc from pt left join i using (pin_id) left join n on n.pin_id = pt.pin_id and rn = 1""")
def terc_fallback(s: Scene) -> DataFrame:
    """A point's own code, else its county's, else that of the nearest city."""
    points = _points(s)
    cities = s.spark.createDataFrame([(i, a, b, t) for i, (a, b, _, _, t) in enumerate(CITIES)], "place int, lat double, lon double, terc string")
    own = F.when(F.col("pin_id") % 10 == 0, "9999")
    near = W.nearest_city(points, cities).withColumnRenamed("terc", "city")
    return points.join(W.in_polygon(points, _squares(s)), "pin_id", "left").join(near, "pin_id", "left").select("pin_id", F.coalesce(own, "code", "city").alias("terc"))
