"""Alert episodes whose state a moved pin, changed settings, a reload and time itself end."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass, fields, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pluvio.streaming import alerts
from pluvio.streaming.alerts import FIRED, NAMES, TTL_MIN, Memory, Settings

#: Hours without a row after which nothing of a pin is known any more.
FORGET_HOURS = 24.0
#: What a row may be. A place, settings or a reload say when they were; a threat is looked at.
KINDS = ("threat", "place", "settings", "reload")
STATE = "episode double, stage string, qualified_at double, clear_since double, hit boolean, place string, saved_at double, last_at double, enabled boolean, lead_min int, min_level int, min_chance int, all_clear boolean"
_SET = tuple(f.name for f in fields(Settings))


@dataclass(frozen=True)
class Held:
    """All that is known of a pin: its episode, the place that the episode is of, when that was saved, the time of its last row, and its settings."""

    memory: Memory = Memory()
    place: str | None = None
    saved_at: float | None = None
    last_at: float | None = None
    settings: Settings = Settings()

    def flat(self) -> tuple:
        return (*astuple(self.memory), self.place, self.saved_at, self.last_at, *astuple(self.settings))

    @classmethod
    def of(cls, state: tuple) -> Held:
        x = [alerts._none(v) for v in state]
        return cls(Memory(*x[:5]), x[5], x[6], x[7], Settings(*x[8:]))


def place_key(lat: float | None, lon: float | None) -> str | None:
    """A place to a thousandth of a degree."""
    return None if lat is None or lon is None else f"{lat:.3f},{lon:.3f}"


def happen(row: dict[str, Any], pin: Any, held: Held) -> tuple[tuple | None, Held]:
    """One row of a pin: the event it fires, if any, and what is known after it.

    A place that is set ends the episode, as its story was of another place. Settings that a row has
    hold from then on. A reload keeps the episode only if it is of the place that is loaded and was
    saved at most 45 minutes ago. After a day without a row the pin starts anew.
    """
    at = row["ts"].timestamp()
    if held.last_at is not None and at - held.last_at > FORGET_HOURS * 3600:
        held = Held()
    held = replace(held, last_at=at if held.last_at is None else max(at, held.last_at))
    key = place_key(alerts._none(row["lat"]), alerts._none(row["lon"]))
    if row["kind"] == "place":
        return None, replace(held, memory=Memory(), place=key, saved_at=at)
    if row["kind"] == "settings":
        own = {name: type(getattr(held.settings, name))(value) for name in _SET if (value := alerts._none(row[name])) is not None}
        return None, replace(held, settings=replace(held.settings, **own))
    if row["kind"] == "reload":
        fresh = held.saved_at is not None and at - held.saved_at <= TTL_MIN * 60
        return None, held if fresh and key == held.place else replace(held, memory=Memory(), place=key)
    event, memory = alerts._look_at({**row, **{name: getattr(held.settings, name) for name in _SET}}, pin, held.memory)
    return event, replace(held, memory=memory, saved_at=at)


def _rows(rows: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` with every column that ``happen`` reads; a column for a setting is null unless its row sets it."""
    have = set(rows.columns)
    absent = {c: F.lit(None).cast("double") for c in ("lat", "lon")} | {"kind": F.lit("threat")}
    rows = rows.withColumns({c: v for c, v in absent.items() if c not in have})
    kinds = {"enabled": "boolean", "lead_min": "int", "min_level": "int", "min_chance": "int", "all_clear": "boolean"}
    own = [(F.col(n) if n in have else F.lit(None)).cast(kinds[n]).alias(f"own_{n}") for n in _SET]
    known = rows.select("kind", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *own, *[c for c in rows.columns if c not in ("kind", "lat", "lon", *_SET)])
    done = alerts._complete(known, settings, keep=("kind", "lat", "lon", *[f"own_{n}" for n in _SET]))
    return done.drop(*_SET).withColumnsRenamed({f"own_{n}": n for n in _SET})


def replay(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008  it is frozen
    """Events of each pin's rows in the order of time, with their words.

    ``rows`` has ``pin_id, ts, event_id, kind`` (``KINDS``) and, for threats, what ``alerts.replay``
    reads; for places and reloads ``lat, lon``; for settings the columns that change. Rows of one
    pin stream through ``happen`` with one state at a time. ``settings`` are those of a pin that has set none.
    """

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pin, held = None, Held(settings=settings)
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                if row["pin_id"] != pin:
                    pin, held = row["pin_id"], Held(settings=settings)
                event, held = happen(row, pin, held)
                out += [event] if event else []
            yield pd.DataFrame(out, columns=NAMES)

    dealt = _rows(rows, settings).repartition("pin_id").sortWithinPartitions("pin_id", "ts", "event_id")
    return alerts.worded(dealt.mapInPandas(run, FIRED))


class Episodes(StatefulProcessor):
    """A pin's ``Held`` as value state, with a timer that ends it a day after its last row."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("held", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        held = Held.of(self.state.get()) if self.state.exists() else Held(settings=self.settings)
        out = []
        for row in pd.concat(list(rows)).sort_values(["ts", "event_id"]).to_dict("records"):  # one micro-batch of one pin
            event, held = happen(row, key[0], held)
            out += [event] if event else []
        self.state.update(held.flat())
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((held.last_at + FORGET_HOURS * 3600) * 1000) + 1)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame([], columns=NAMES)

    def close(self) -> None:
        """Nothing is held beside the state."""


def stream(rows: DataFrame, settings: Settings = Settings(), late: str = "1 hour") -> DataFrame:  # noqa: B008  it is frozen
    """As ``replay``, on a stream of threats and changes alike. Rows more than ``late`` behind the newest are dropped, so that a pin's timer never fires before a row it would have kept."""
    keyed = _rows(rows, settings).withWatermark("ts", late).groupBy("pin_id")
    return alerts.worded(keyed.transformWithStateInPandas(Episodes(settings), FIRED, "append", "EventTime"))
