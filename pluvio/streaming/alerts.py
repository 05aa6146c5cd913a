"""Alert episodes: one pure step, folded over a batch or kept as state on a stream."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, fields, replace
from functools import reduce
from operator import add
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.operators import alert_rules as R

STALE_MIN, TTL_MIN, DEBOUNCE_MIN, DECAY_MIN, HOLD_MIN, HYSTERESIS_MIN = 30, 45, 3, 10, 15, 10
CLEAR_KM, OVER_KM = 20.0, 8.0


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    lead_min: int = 30
    min_level: int = 2
    min_chance: int = 50
    all_clear: bool = True


@dataclass(frozen=True)
class Memory:
    """What an episode remembers; times in seconds."""

    episode: float | None = None
    stage: str = "idle"
    qualified_at: float | None = None
    clear_since: float | None = None
    hit: bool = False


@dataclass(frozen=True)
class Look:
    """What one threat means under a pin's settings. ``eta`` is from the frame, ``wall`` from now."""

    over: bool
    coming: bool
    eta: float | None
    wall: int | None
    level: int
    in_play: bool
    far: bool
    dry: bool


#: What is told in a stage, by whether rain is over the pin; in between nothing is.
TOLD = {("idle", True): "now", ("incoming", True): "now", ("idle", False): "incoming"}


def _none(x: Any) -> Any:
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else x


def eta_to_level(threat: dict[str, Any], least: int) -> float | None:
    """Minutes to the first step of the timeline of a class; the mass's own arrival where a step is unknown, or without a timeline."""
    steps = threat.get("timeline")
    own = _none(threat.get("eta")) if threat["will_hit"] and threat["cell_level"] >= least else None
    if not threat.get("timeline_advected") or steps is None or not len(steps):
        return own
    known = [p["t"] for p in steps if not p["unknown"] and p["level"] >= least]
    return known[0] if known else own if any(p["unknown"] for p in steps) else None


def look(threat: dict[str, Any], settings: Settings, stage: str, age: float) -> Look:
    near, pin, receding = _none(threat.get("nearest_km")), threat["pin_level"], bool(threat["receding"])
    over = _none(threat.get("eta")) == 0 and near is not None and near <= OVER_KM and pin >= settings.min_level
    eta = eta_to_level(threat, settings.min_level)
    wall = None if eta is None else max(0, math.floor(eta - age + 0.5))
    lead = settings.lead_min + (0 if stage == "idle" else HYSTERESIS_MIN)
    coming = not over and not receding and wall is not None and eta > 0 and wall <= lead and threat["chance"] >= settings.min_chance
    steps = threat.get("timeline") if eta is not None and threat.get("timeline_advected") else None
    peak = max((p["level"] for p in (steps if steps is not None else ()) if eta <= p["t"] <= eta + 30), default=0)
    return Look(
        over, coming, eta, 0 if over else wall, pin if over else max(threat["cell_level"], pin, peak), (eta is not None and eta <= settings.lead_min + HOLD_MIN) or bool(threat["approaching"]),
        near is None or near > CLEAR_KM or (receding and near > OVER_KM), pin < settings.min_level,
    )


def step(threat: dict[str, Any], settings: Settings, memory: Memory, now: float) -> tuple[dict[str, Any] | None, Memory, str]:
    """One look at a pin: the event to fire, if any, the memory after it, and why.

    ``threat`` has ``radar_time, eta, nearest_km, pin_level, cell_level, will_hit, approaching,
    receding, chance`` and may have ``timeline`` and ``timeline_advected``: what counts is when rain
    of the class that was asked for comes, not the first drop. Old radar changes nothing. An episode
    fires each of ``incoming``, ``now`` and ``allclear`` once; it ends when rain has left for some
    minutes, or silently when nothing has qualified for 45.
    """
    radar = _none(threat.get("radar_time"))
    if not settings.enabled:
        return None, memory, "disabled"
    if radar is None or now - radar > STALE_MIN * 60:
        return None, memory, "stale"
    seen = look(threat, settings, memory.stage, max(0.0, (now - radar) / 60))
    kind, episode, after, why = fold(seen, memory, settings.all_clear, now)
    told = {"eta": seen.wall, "level": seen.level, "chance": threat["chance"], "hit": memory.hit, "far": seen.far}
    return ({**told, "kind": kind, "episode": episode} if kind else None), after, why


def fold(seen: Look, memory: Memory, all_clear: bool, now: float) -> tuple[str | None, float | None, Memory, str]:
    """What a look makes of an episode: the kind of the event to fire, if any, the episode it is of, the memory after it, and why."""
    if seen.over or seen.coming:
        episode = now if memory.stage == "idle" else memory.episode
        kind = TOLD.get((memory.stage, seen.over))
        after = replace(memory, episode=episode, stage=kind or memory.stage, qualified_at=now, clear_since=None, hit=memory.hit or kind == "now")
        return kind, episode, after, "fired" if kind else "told"
    if memory.qualified_at is not None and now - memory.qualified_at > TTL_MIN * 60:
        memory = Memory()
    if memory.stage == "idle":
        return None, None, memory, "idle"
    decayed = memory.hit and seen.dry
    if (seen.in_play and not memory.hit) or not (seen.far or decayed):
        return None, None, replace(memory, clear_since=None), "held"
    since = now if memory.clear_since is None else memory.clear_since
    wait = DEBOUNCE_MIN if seen.far else DECAY_MIN
    if memory.clear_since is None or now - since < wait * 60:
        return None, None, replace(memory, clear_since=since), "clearing"
    return ("allclear" if all_clear else None), memory.episode, Memory(), "clear"


#: What an event takes over from the threat for its words.
TAKEN = {"label": "string", "coming_from": "string", "toward": "string", "speed_kmh": "double", "expect": "string", "lightning_near_cell": "boolean", "source": "string"}
FIRED = "pin_id long, at timestamp, kind string, episode double, eta double, level int, chance int, hit boolean, far boolean, radar_time double, " + ", ".join(f"{c} {t}" for c, t in TAKEN.items())


def _complete(threats: DataFrame, settings: Settings, keep: tuple[str, ...] = ()) -> DataFrame:
    """``threats`` with what may be absent: words, timeline, the radar's time (that of the look), and settings, which a pin may have of its own."""
    have = set(threats.columns)
    absent = {c: F.lit(None).cast(t) for c, t in TAKEN.items()} | {"timeline": F.lit(None).cast("array<struct<t:int,level:int,rate:double,unknown:boolean>>"), "timeline_advected": F.lit(False), "event_id": F.lit(0), "cell_level": F.col("level")}
    absent |= {k: F.lit(v) for k, v in asdict(settings).items()}
    rows = threats.withColumn("ts", F.col("ts").cast("timestamp")).withColumns({c: v for c, v in absent.items() if c not in have})
    rows = rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in asdict(settings).items()})
    if "radar_time" not in have:
        rows = rows.withColumn("radar_time", F.unix_micros("ts") / 1e6)
    return rows.select("pin_id", "ts", "event_id", "radar_time", "eta", "nearest_km", "pin_level", "cell_level", "will_hit", "approaching", "receding", "chance", "timeline", "timeline_advected", *TAKEN, *asdict(settings), *keep)


def _look_at(row: dict[str, Any], pin: Any, memory: Memory) -> tuple[tuple | None, Memory]:
    at = row["ts"].timestamp()
    settings = Settings(**{f.name: row[f.name] for f in fields(Settings)})
    event, memory, _ = step(row, settings, memory, at)
    if event is None:
        return None, memory
    return (pin, row["ts"], *(event[c] for c in ("kind", "episode", "eta", "level", "chance", "hit", "far")), row["radar_time"], *(_none(row[c]) for c in TAKEN)), memory


NAMES = [c.split()[0] for c in FIRED.split(", ")]


def worded(events: DataFrame) -> DataFrame:
    """``pin_id, at, kind, episode, event_id, eta, level, chance, title, body`` of fired events."""
    return events.select(
        "pin_id", "at", "kind", "episode", F.concat_ws(":", F.round(F.col("episode") * 1000).cast("long").cast("string"), "kind").alias("event_id"), F.col("eta").cast("int").alias("eta"), "level", "chance",
        R.event_title().alias("title"), R.event_body().alias("body"),
    )


#: What a threat means, each as one bit of ``seen``: that it counts at all, and what ``Look`` has, of which ``later`` is ``coming`` while an episode runs.
COUNTS, IS_OVER, IS_COMING, IS_LATER, IN_PLAY, IS_FAR, IS_DRY, TELLS_CLEAR = (1 << n for n in range(8))


def fresh() -> Column:
    """Whether a threat counts: alerts are on, and its radar is not old."""
    radar = F.col("radar_time").cast("double")
    return F.coalesce(F.col("enabled") & ~F.isnan(radar) & (F.unix_micros("ts") / 1e6 - radar <= STALE_MIN * 60), F.lit(False))


def looked(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``_complete``) with ``now``, ``seen`` (the bits above), and ``far`` and what an event tells: ``eta, level, chance``. As ``look``, by Spark for all rows at once, so that no timeline goes to Python."""
    no = lambda c: F.coalesce(c, F.lit(False))
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    least, pin, lead = F.col("min_level"), F.col("pin_level"), F.col("lead_min")
    rows = rows.withColumns({"now": F.unix_micros("ts") / 1e6, "radar_time": real("radar_time"), "speed_kmh": real("speed_kmh"), "__eta": real("eta"), "__near": real("nearest_km"), "__line": F.when(no(F.col("timeline_advected")) & (F.size("timeline") > 0), F.col("timeline"))})
    line = F.col("__line")
    hit = F.filter(line, lambda p: (p["level"] >= least) & ~no(p["unknown"]))
    own = F.when(no(F.col("will_hit")) & (F.col("cell_level") >= least), F.col("__eta"))
    reached = F.when(line.isNull(), own).when(F.size(hit) > 0, F.get(hit, F.lit(0))["t"].cast("double")).when(F.exists(line, lambda p: no(p["unknown"])), own)
    rows = rows.withColumns({"__reach": reached, "__age": F.greatest(F.lit(0.0), (F.col("now") - F.col("radar_time")) / 60)})
    reach, near, quiet = F.col("__reach"), F.col("__near"), no(F.col("receding"))
    peak = F.array_max(F.transform(F.filter(line, lambda p: (p["t"] >= reach) & (p["t"] <= reach + 30)), lambda p: p["level"]))
    wall = F.when(reach.isNotNull(), F.greatest(F.lit(0).cast("long"), F.floor(reach - F.col("__age") + 0.5)))
    over = no((F.col("__eta") == 0) & (near <= OVER_KM) & (pin >= least))
    rows = rows.withColumns({"__over": over, "__wall": wall, "__peak": F.coalesce(peak, F.lit(0)), "far": near.isNull() | no(near > CLEAR_KM) | no(quiet & (near > OVER_KM))})
    over, wall = F.col("__over"), F.col("__wall")
    due = ~over & ~quiet & no((reach > 0) & (F.col("chance") >= F.col("min_chance")))
    bits = {
        COUNTS: fresh(), IS_OVER: over, IS_COMING: due & no(wall <= lead), IS_LATER: due & no(wall <= lead + HYSTERESIS_MIN),
        IN_PLAY: no(reach <= lead + HOLD_MIN) | no(F.col("approaching")), IS_FAR: F.col("far"), IS_DRY: no(pin < least), TELLS_CLEAR: no(F.col("all_clear")),
    }
    seen = reduce(add, [F.when(c, n).otherwise(0) for n, c in bits.items()])
    told = {"eta": F.when(over, 0).otherwise(wall).cast("double"), "level": F.when(over, pin).otherwise(F.greatest("cell_level", pin, "__peak")).cast("int"), "chance": F.col("chance").cast("int")}
    return rows.withColumns({"seen": seen, **told}).drop("__eta", "__near", "__line", "__reach", "__age", "__over", "__wall", "__peak")


def folded(seen: int, memory: Memory, now: float) -> tuple[str | None, float | None, Memory]:
    """``fold`` of the bits of ``looked``; what an idle pin has no use for is passed over."""
    idle = memory.stage == "idle"
    if not seen & COUNTS or (idle and not seen & (IS_OVER | IS_COMING)):
        return None, None, memory
    on = lambda bit: bool(seen & bit)
    own = Look(on(IS_OVER), on(IS_COMING if idle else IS_LATER), None, None, 0, on(IN_PLAY), on(IS_FAR), on(IS_DRY))
    return fold(own, memory, on(TELLS_CLEAR), now)[:3]


#: What the replay deals to the pins of each row.
DEALT = ("ts", "event_id", "now", "seen", "eta", "level", "chance", "far", "radar_time", *TAKEN)


def told(batch: pa.RecordBatch, fired: list[tuple[int, str, float | None, bool]]) -> pa.RecordBatch:
    """The rows of a batch that fire (place, kind, episode, hit) as ``FIRED``."""
    at, kinds, episodes, hits = zip(*fired, strict=True) if fired else ((), (), (), ())
    rows = batch.take(pa.array(at, pa.int64()))
    more = {"at": rows.column("ts"), "kind": pa.array(kinds, pa.string()), "episode": pa.array(episodes, pa.float64()), "hit": pa.array(hits, pa.bool_())}
    return pa.RecordBatch.from_arrays([more[c] if c in more else rows.column(c) for c in NAMES], NAMES)


def replay(threats: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008  it is frozen
    """Events of each pin's threats (``pin_id, ts, ...``) in the order of time, with their words.

    Spark looks at every row (``looked``); what counts is dealt by pin, sorted, and streams through
    ``fold`` with one memory at a time, so that a pin may have any number of rows. Columns named as
    a setting hold each pin's own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pin, memory = object(), Memory()
        for batch in batches:
            fired = []
            for n, (own, now, seen) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pin_id", "now", "seen")), strict=True)):
                if own != pin:
                    pin, memory = own, Memory()
                hit = memory.hit
                kind, episode, memory = folded(seen, memory, now)
                if kind:
                    fired.append((n, kind, episode, hit))
            yield told(batch, fired)

    dealt = looked(_complete(threats, settings).where(fresh())).select(F.col("pin_id").cast("long").alias("pin_id"), *DEALT).repartition("pin_id").sortWithinPartitions("pin_id", "ts", "event_id")
    return worded(dealt.mapInArrow(run, FIRED))


def stream(threats: DataFrame, settings: Settings = Settings(), late: str = "1 hour", forget_hours: float = 24.0) -> DataFrame:  # noqa: B008  it is frozen
    """As ``replay``, on a stream: each pin's memory is state, which goes when the stream's time has passed the pin's last threat by ``forget_hours``. Threats more than ``late`` behind the newest are dropped."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        memory = Memory(*(_none(x) for x in held)) if held else Memory()
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])  # one micro-batch of one pin
        out = []
        for row in rows.to_dict("records"):
            event, memory = _look_at(row, key[0], memory)
            out += [event] if event else []
        state.update((memory.episode, memory.stage, memory.qualified_at, memory.clear_since, memory.hit))
        state.setTimeoutTimestamp(int((rows["ts"].max().timestamp() + forget_hours * 3600) * 1000))
        yield pd.DataFrame(out, columns=NAMES)

    kept = "episode double, stage string, qualified_at double, clear_since double, hit boolean"
    rows = _complete(threats, settings).withWatermark("ts", late)
    return worded(rows.groupBy("pin_id").applyInPandasWithState(run, FIRED, kept, "append", GroupStateTimeout.EventTimeTimeout))


def rate_limited(calls: DataFrame, most: int = 10, seconds: int = 60) -> DataFrame:
    """``client, ts, allowed`` of each call: at most ``most`` allowed ones in any ``seconds``. Calls stream through by client, in order."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, recent = None, []
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                if row.client != client:
                    client, recent = row.client, []
                at = row.ts.timestamp()
                recent = [t for t in recent if at - t < seconds]
                if len(recent) < most:
                    recent.append(at)
                    out.append((row.client, row.ts, True))
                else:
                    out.append((row.client, row.ts, False))
            yield pd.DataFrame(out, columns=["client", "ts", "allowed"])

    dealt = calls.select("client", F.col("ts").cast("timestamp").alias("ts")).repartition("client").sortWithinPartitions("client", "ts")
    return dealt.mapInPandas(run, "client long, ts timestamp, allowed boolean")
