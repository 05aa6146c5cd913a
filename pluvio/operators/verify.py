"""How forecasts fared: contingency, calibration and bias."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pluvio.functions.const import LEADS, MAX_CELLS, OVER_KM
from pluvio.operators.alert_rules import eta_to_level
from pluvio.operators.spatial import range_join

BUCKETS = ((0, 19), *((x, x + 9) for x in range(20, 90, 10)), (90, 100))


def skill(facts: DataFrame, *by: str) -> DataFrame:
    """Hits, misses, false alarms and correct negatives of ``pred`` and ``obs``, with POD, FAR and CSI."""
    p, o = F.col("pred"), F.col("obs")
    counts = facts.groupBy(*by).agg(F.count_if(p & o).alias("hit"), F.count_if(~p & o).alias("miss"), F.count_if(p & ~o).alias("fa"), F.count_if(~p & ~o).alias("cn"))
    part = lambda a, b: F.col(a) / F.greatest(F.lit(1), b)
    h, m, f = F.col("hit"), F.col("miss"), F.col("fa")
    return counts.withColumns({"pod": part("hit", h + m), "far": part("fa", h + f), "csi": part("hit", h + m + f)})


def percentile(values: Column, part: float) -> Column:
    """Of a sorted array, the value at the floor of its size times ``part``."""
    return F.when(F.size(values) > 0, F.element_at(values, F.floor(F.size(values) * part).cast("int") + 1))


def calibration(facts: DataFrame) -> DataFrame:
    """Nine buckets of ``chance``: how many, their mean and how often ``obs`` held; empty ones too."""
    dim = facts.sparkSession.createDataFrame(BUCKETS, "low int, high int")
    low = F.when(F.col("chance") < 20, 0).otherwise(F.least(F.lit(90), F.floor(F.col("chance") / 10) * 10)).cast("int")
    sums = facts.groupBy(low.alias("low")).agg(F.count("*").alias("n"), F.avg("chance").alias("mean"), F.avg(F.col("obs").cast("double")).alias("observed"))
    return F.broadcast(dim).join(sums, "low", "right").unionByName(dim.join(sums, "low", "left_anti").withColumns({"n": F.lit(0).cast("long"), "mean": F.lit(None).cast("double"), "observed": F.lit(None).cast("double")}))


def scored_frames(frames: DataFrame, history: int = 4, leads: tuple[int, ...] = LEADS) -> DataFrame:
    """``frame_time`` of the frames that can be scored: with ``history - 1`` frames before, and the whole lead window after.

    Raises where there are fewer than ``history`` frames, or none can be scored.
    """
    times = frames.select("frame_time").distinct()
    order = Window.orderBy("frame_time")  # one row a frame
    placed = times.withColumns({"place": F.row_number().over(order), "final": F.max("frame_time").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    n, first, final = placed.agg(F.count("*"), F.min(F.when(F.col("place") == history, F.col("frame_time"))), F.max("final")).first()
    if n < history:
        raise ValueError(f"{history} frames or more are needed, there are {n}")
    if first + max(leads) * 60 > final:
        raise ValueError(f"{max(leads)} minutes are needed after the first scored frame")
    return placed.where((F.col("place") >= history) & (F.col("frame_time") + max(leads) * 60 <= F.col("final"))).select("frame_time")


def observed_at_leads(samples: DataFrame, pins: DataFrame, leads: tuple[int, ...] = LEADS, km: float = OVER_KM) -> DataFrame:
    """For each pin, scored frame and lead the class observed then: ``pin_id, frame_time, lead, obs``. A lead without a frame raises an error."""
    frames = samples.select("frame_time").distinct()
    times = scored_frames(frames, leads=leads).select("frame_time", F.explode(F.array(*map(F.lit, leads))).alias("lead")).withColumn("valid", F.col("frame_time") + F.col("lead") * 60)
    times = times.join(frames.select(F.col("frame_time").alias("there")), F.col("valid") == F.col("there"), "left")
    absent = F.raise_error(F.format_string("no frame %s minutes after %s", F.col("lead").cast("string"), F.col("frame_time").cast("string"))).cast("long")
    times = times.withColumn("valid", F.coalesce("there", absent)).drop("there")
    points = samples.select(F.col("frame_time").alias("valid"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "level")
    wet = range_join(pins.select("pin_id", "lat", "lon"), points, km).groupBy("pin_id", "valid").agg(F.max("level").alias("obs"))
    return times.crossJoin(pins.select("pin_id")).join(wet, ["pin_id", "valid"], "left").fillna(0, ["obs"]).drop("valid")  # the answer has a row for each


THRESHOLDS = (1, 2)
#: Settings under which alerts are scored: lead in minutes and least chance.
RESEARCH, SHIPPED = (60, 0), (30, 50)
SHIPPED_LEVEL = 2


@dataclass
class Hindcast:
    """What a hindcast says, as tables."""

    nowcast: DataFrame
    persistence: DataFrame
    alerts: DataFrame
    calibration: DataFrame
    mix: DataFrame


def _incoming(thr: Column, lead: int, chance: int) -> tuple[Column, Column]:
    """Whether an alert without a past fires as coming, and its minutes; the radar is new."""
    mass = F.when(F.col("will_hit") & (F.col("cell_level") >= thr), F.col("eta"))
    eta = F.when(F.col("timeline_advected"), eta_to_level(F.col("timeline"), thr, mass)).otherwise(mass)
    over = F.coalesce((F.col("eta") == 0) & (F.col("nearest_km") <= OVER_KM) & (F.col("pin_level") >= thr), F.lit(False))
    return F.coalesce(~over & ~F.col("receding") & (eta > 0) & (eta <= lead) & (F.col("chance") >= chance), F.lit(False)), eta


def hindcast(threats: DataFrame, observed: DataFrame) -> Hindcast:
    """Threats of scored scans (``scan_time, pin_id, ...``) against what was ``observed`` at the leads. Pins without echo within 100 km count in the mix alone."""
    wide = observed.groupBy(F.col("frame_time").alias("scan_time"), "pin_id").agg(F.map_from_entries(F.collect_list(F.struct("lead", "obs"))).alias("seen_at"))
    cases = threats.where("nearest_km is not null").join(wide, ["scan_time", "pin_id"])
    first = lambda thr, most: F.array_min(F.filter(F.map_keys("seen_at"), lambda k: (k <= most) & (F.element_at("seen_at", k) >= thr)))
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("thr"), F.lit(x).alias("lead")) for t in THRESHOLDS for x in LEADS]))
    steps = cases.select("timeline", "pin_level", "seen_at", at.alias("k")).select("timeline", "pin_level", "k.*", (F.element_at("seen_at", F.col("k.lead")) >= F.col("k.thr")).alias("obs"))
    now = F.element_at(F.filter("timeline", lambda p: p["t"] == F.col("lead")), 1)["level"] >= F.col("thr")
    nowcast = skill(steps.select("thr", "lead", now.alias("pred"), "obs"), "thr", "lead")
    persistence = skill(steps.select("thr", "lead", (F.col("pin_level") >= F.col("thr")).alias("pred"), "obs"), "thr", "lead")
    parts, configs = [], [*(("research", t, RESEARCH) for t in THRESHOLDS), ("shipped", SHIPPED_LEVEL, SHIPPED)]
    for name, thr, (lead, chance) in configs:
        pred, eta = _incoming(F.lit(thr), lead, chance)
        seen = first(F.lit(thr), F.lit(lead))
        parts.append(cases.where(F.col("pin_level") < thr).select(F.lit(name).alias("config"), F.lit(thr).alias("thr"), pred.alias("pred"), seen.isNotNull().alias("obs"), F.when(pred, eta - seen).alias("bias")))
    facts = functools.reduce(DataFrame.unionByName, parts)
    every = threats.sparkSession.createDataFrame([(name, thr) for name, thr, _ in configs], "config string, thr int")
    alerts = every.join(skill(facts, "config", "thr"), ["config", "thr"], "left").fillna(0).join(bias_percentiles(facts.where("bias is not null"), "config", "thr"), ["config", "thr"], "left")
    rain = calibration(cases.select("chance", first(F.lit(1), F.lit(60)).isNotNull().alias("obs")))
    return Hindcast(nowcast, persistence, alerts, rain, motion_mix(threats))


def motion_mix(threats: DataFrame) -> DataFrame:
    """How many threats there are, how many with echo within 100 km, and by what the motion of these was found, in percent."""
    kind = F.when(F.col("timeline_advected"), "advected").when(F.col("will_hit") & (F.col("eta") > 0), "crude").otherwise("persist")
    some = F.col("nearest_km").isNotNull()
    share = lambda k: (100.0 * F.count_if(some & (kind == k)) / F.greatest(F.lit(1), F.count_if(some))).alias(k)
    return threats.agg(F.count("*").alias("n_all"), F.count_if(some).alias("n_echo"), *map(share, ("advected", "crude", "persist")))


def bias_percentiles(facts: DataFrame, *by: str) -> DataFrame:
    """``n, p10, p50, p90`` of ``bias``, by counts of each value, so that no list of all forms: the value whose run holds the rank."""
    counts = facts.groupBy(*by, "bias").agg(F.count("*").alias("k"))
    runs = counts.withColumns({"upto": F.sum("k").over(Window.partitionBy(*by).orderBy("bias")), "total": F.sum("k").over(Window.partitionBy(*by))})
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("bias")))
    return runs.groupBy(*by).agg(F.max("total").alias("n_bias"), pick(0.1).alias("p10"), pick(0.5).alias("p50"), pick(0.9).alias("p90"))


def long_form(h: Hindcast) -> DataFrame:
    """A hindcast as one table: ``section, config, thr, lead, name, value``."""
    def melt(df: DataFrame, section: str, keys: dict[str, Column], values: tuple[str, ...]) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")
        return df.select(F.lit(section).alias("section"), *[keys.get(k, F.lit(None).cast(t)).cast(t).alias(k) for k, t in (("config", "string"), ("thr", "int"), ("lead", "int"))], pairs).select("section", "config", "thr", "lead", "x.*")

    rates = ("hit", "miss", "fa", "cn", "pod", "far", "csi")
    two = {"thr": F.col("thr"), "lead": F.col("lead")}
    parts = [
        melt(h.nowcast, "nowcast", two, rates), melt(h.persistence, "persistence", two, rates), melt(h.alerts, "alerts", {"config": F.col("config"), "thr": F.col("thr")}, (*rates, "n_bias", "p10", "p50", "p90")),
        melt(h.calibration, "chance", {"lead": F.col("low")}, ("n", "mean", "observed")), melt(h.mix, "motion", {}, ("n_all", "n_echo", "advected", "crude", "persist")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def report(h: Hindcast) -> DataFrame:
    """A hindcast as lines of text for people, ``place, line``."""
    part = lambda c: F.format_string("%3.0f%%", F.col(c) * 100)
    scores = F.concat(F.lit("POD "), part("pod"), F.lit("  FAR "), part("far"), F.lit("  CSI "), part("csi"), F.format_string("  (n=%d, obs=%d)", F.col("hit") + F.col("miss") + F.col("fa") + F.col("cn"), F.col("hit") + F.col("miss")))
    eta = F.coalesce(F.format_string("median %s, p10 %s, p90 %s (n=%s)", *[F.col(c).cast("int") for c in ("p50", "p10", "p90", "n_bias")]), F.lit("n/a (no hits)"))
    bias = F.when(F.col("n_bias").isNull(), "n/a (no hits)").otherwise(eta)
    lines = [
        h.mix.select(F.lit(0).alias("place"), F.format_string("Motion (echo within 100 km): advected %.0f%%  persist %.0f%%  crude ETA %.0f%%  (echo=%d, all=%d)", "advected", "persist", "crude", "n_echo", "n_all").alias("line")),
        h.nowcast.select((F.col("thr") * 1000 + F.col("lead") * 2).alias("place"), F.concat(F.format_string("class %d +%2d min  nowcast  ", "thr", "lead"), scores).alias("line")),
        h.persistence.select((F.col("thr") * 1000 + F.col("lead") * 2 + 1).alias("place"), F.concat(F.format_string("class %d +%2d min  persist  ", "thr", "lead"), scores).alias("line")),
        h.alerts.select((F.lit(5000) + F.col("thr") + F.when(F.col("config") == "shipped", 10).otherwise(0)).alias("place"), F.concat(F.format_string("alert %s, class %d:  ", "config", "thr"), scores, F.lit("  ETA less first observed: "), bias).alias("line")),
        h.calibration.where("n > 0").select((F.lit(6000) + F.col("low")).alias("place"), F.format_string("chance %d-%d  n=%d  mean %.0f  observed %.0f%%", F.col("low"), F.col("high"), F.col("n"), F.col("mean"), F.col("observed") * 100).alias("line")),
    ]
    return functools.reduce(DataFrame.unionByName, lines).select(F.col("place").cast("int"), "line")


def cell_km_of_count(n: Column) -> Column:
    """The size of cells that a frame of ``n`` cells of 3 km is held in: doubled, at most to 24 km, until no more than 9,000 are left."""
    fits = lambda f: F.ceil(n / float(f * f)) <= MAX_CELLS
    return F.when(n <= MAX_CELLS, 3.0).when(fits(2), 6.0).when(fits(4), 12.0).otherwise(24.0)


def run_facts(samples: DataFrame, downloaded_at: Column | None = None) -> DataFrame:
    """One row about the frames of a run: ``date, radar_from, radar_to, frames, latest_age_sec, cell_kms, least, most``; the age is null without the time at which the last frame was fetched (seconds)."""
    frames = samples.groupBy("frame_time").agg(F.count("*").alias("n"))
    iso = lambda t: F.date_format(F.to_utc_timestamp(F.timestamp_seconds(t), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    of = frames.agg(F.min("frame_time").alias("a"), F.max("frame_time").alias("b"), F.count("*").alias("frames"), F.sort_array(F.collect_set(cell_km_of_count(F.col("n")))).alias("cell_kms"), F.min("n").alias("least"), F.max("n").alias("most"))
    age = F.lit(None).cast("long") if downloaded_at is None else F.floor(downloaded_at - F.col("b") + 0.5).cast("long")
    return of.select(F.substring(iso(F.col("b")), 1, 10).alias("date"), iso(F.col("a")).alias("radar_from"), iso(F.col("b")).alias("radar_to"), "frames", age.alias("latest_age_sec"), "cell_kms", "least", "most")


def summary(h: Hindcast, facts: DataFrame, run_at: Column) -> DataFrame:
    """A hindcast as one document, ``summary`` (JSON): the run's frames (``run_facts``), motion, the skill of nowcast and persistence by class and lead, alerts and chances. Empty scores are 0, a bias without hits is null."""
    rates = ("hit", "miss", "fa", "cn", "pod", "far", "csi")
    skill_of = F.struct(*rates, (F.col("hit") + F.col("miss") + F.col("fa") + F.col("cn")).alias("n"), (F.col("hit") + F.col("miss")).alias("obs"))
    bias = F.when(F.col("n_bias").isNotNull(), F.struct(F.col("n_bias").alias("n"), "p10", "p50", "p90"))
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    keyed = lambda df, key, value, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("key"), value.alias("value"))), by_key)).alias(name))

    def by_lead(df: DataFrame, name: str) -> DataFrame:
        leads = df.groupBy("thr").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("lead").cast("string").alias("key"), skill_of.alias("value"))), by_key)).alias("leads"))
        return keyed(leads, F.col("thr").cast("string"), F.col("leads"), name)

    research = keyed(h.alerts.where("config = 'research'"), F.col("thr").cast("string"), F.struct(skill_of.alias("skill"), bias.alias("etaBiasMin")), "by_threshold")
    shipped = h.alerts.where("config = 'shipped'").agg(F.first(F.struct(F.lit(SHIPPED[0]).alias("leadMin"), F.lit(SHIPPED_LEVEL).alias("minLevel"), F.lit(SHIPPED[1]).alias("minChancePct"), skill_of.alias("skill"), bias.alias("etaBiasMin"))).alias("shipped"))
    bucket = F.struct("low", F.concat_ws("-", "low", "high").alias("bucket"), F.col("low").alias("lo"), F.col("high").alias("hi"), "n", F.coalesce("mean", F.lit(0.0)).alias("meanChancePct"), F.coalesce("observed", F.lit(0.0)).alias("observedRate"))
    chances = h.calibration.agg(F.transform(F.sort_array(F.collect_list(bucket)), lambda b: b.dropFields("low")).alias("szansa"))
    motion = h.mix.select(F.struct(F.col("n_all").alias("allCases"), F.col("n_echo").alias("echoCases"), F.col("advected").alias("advectedPct"), F.col("persist").alias("persistPct"), F.col("crude").alias("crudeEtaPct")).alias("motion"))
    row = functools.reduce(DataFrame.crossJoin, [facts, motion, by_lead(h.nowcast, "nowcast"), by_lead(h.persistence, "persist"), research, shipped, chances])  # one row each
    radar = F.struct(F.col("radar_from").alias("from"), F.col("radar_to").alias("to"), "frames", F.col("latest_age_sec").alias("latestAgeSec"))
    alerts = F.struct(F.struct(F.lit(RESEARCH[0]).alias("leadMin"), F.lit(RESEARCH[1]).alias("minChancePct"), F.col("by_threshold").alias("byThreshold")).alias("research"), "shipped")
    document = F.struct("date", F.date_format(F.to_utc_timestamp(run_at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("runAt"), radar.alias("radar"), F.col("cell_kms").alias("cellKm"), F.struct(F.col("least").alias("min"), F.col("most").alias("max")).alias("sampleCount"), "motion", "nowcast", "persist", alerts.alias("alerts"), "szansa")
    return row.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("summary"))
