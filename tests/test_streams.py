"""Polling, joins of streams, episodes that end, and delivery: each against its batch form, across restarts and odd orders."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pluvio.plans import stream_queries as SQ
from pluvio.plans.fixtures import Scene
from pluvio.sources import polling
from pluvio.streaming import alerts, delivery, episodes
from pluvio.streaming.strikes import strikes_by_cell

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frame(spark, folder, t, n=3, name="part"):
    rows = [(52.0 + i / 10, 20.0, 1 + i % 3, 1.0, 3.0) for i in range(n)]
    spark.createDataFrame(rows, "lat double, lon double, level int, rate double, cell_km double").coalesce(1).write.mode("append").parquet(f"{folder}/frame_time={t}")


def looked(spark, folder, out, state, newest):
    run = polling.poll(spark, folder, newest=newest).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(polling.SAMPLES).parquet(out)
    return {r["frame_time"]: r["count"] for r in found.groupBy("frame_time").count().collect()}


def test_polling_reads_each_file_once_across_restarts(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    times = [1_704_067_200 + 300 * k for k in range(12)]
    for t in times[:3]:
        frame(spark, folder, t)
    assert looked(spark, folder, out, state, 4) == dict.fromkeys(times[:3], 3)
    assert looked(spark, folder, out, state, 4) == dict.fromkeys(times[:3], 3)  # a restart with nothing new
    for t in times[3:5]:
        frame(spark, folder, t)
    assert looked(spark, folder, out, state, 4) == dict.fromkeys(times[:5], 3)
    # Six frames came between two looks: the newest four are read, the others never.
    for t in times[5:11]:
        frame(spark, folder, t)
    seen = dict.fromkeys([*times[:5], *times[7:11]], 3)
    assert looked(spark, folder, out, state, 4) == seen
    # A file that comes late to a frame of the window is read; one of a frame behind it is not.
    frame(spark, folder, times[9], 2)
    frame(spark, folder, times[5], 2)
    seen[times[9]] += 2
    assert looked(spark, folder, out, state, 4) == seen
    assert sorted(r["frame_time"] for r in polling.newest_frames(spark, folder, 4).select("frame_time").distinct().collect()) == times[7:11]


def test_a_batch_that_was_not_committed_is_read_again(spark, tmp_path):
    """The offsets alone say what a batch reads, so that it is the same whenever it is asked for."""
    folder = str(tmp_path / "in")
    options = polling._Options({"path": folder, "newest": "2"})
    stream = polling.FrameStream(options, None)
    looks = [stream.initialOffset(), stream.latestOffset()]
    assert looks[1]["seen"] == [] and stream.partitions(*looks) == []
    for t in (1_704_067_200, 1_704_067_500, 1_704_067_800):
        frame(spark, folder, t)
        looks.append(stream.latestOffset())
    first = [[p.stamp for p in stream.partitions(a, b)] for a, b in zip(looks[:-1], looks[1:], strict=True)]
    again = [[p.stamp for p in polling.FrameStream(options, None).partitions(a, b)] for a, b in zip(looks[:-1], looks[1:], strict=True)]
    assert first == again == [[], [1_704_067_200], [1_704_067_500], [1_704_067_800]]
    assert [p.stamp for p in stream.partitions(looks[0], looks[-1])] == [1_704_067_500, 1_704_067_800]


def test_a_folder_without_frames_has_none(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "notes.txt").write_text("frame_time=1704067200")
    (tmp_path / "in" / "_frame_time=1704067200.parquet").write_text("x")
    assert polling.newest_frames(spark, str(tmp_path / "in")).count() == polling.newest_frames(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(ValueError, match="path"):
        polling._Options({})


# Strikes beside cells


def test_strikes_join_cells_on_streams_in_any_order(spark, tmp_path):
    """Both streams in shuffled order, a part at a time: the rows of the batch, and no more state than the window needs."""
    rng, start = random.Random(2), 1_704_067_200
    cells = [(k, start + 60 * k, 50 + rng.random(), 20 + rng.random()) for k in range(600)]
    strikes = [(k, start + 45 * k + 7, 50 + rng.random(), 20 + rng.random()) for k in range(800)]
    at = lambda c: F.timestamp_seconds(c)
    kinds = ("cell_id long, t long, lat double, lon double", "strike_id long, t long, lat double, lon double")
    frames = []
    for name, rows, kind, when in (("cells", cells, kinds[0], "seen_at"), ("strikes", strikes, kinds[1], "struck_at")):
        # A row comes up to nine minutes after its time.
        order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 540))
        for k in range(0, len(order), 50):
            spark.createDataFrame(order[k : k + 50], kind).coalesce(1).write.parquet(str(tmp_path / name / f"{k:05d}"))
        read = lambda r, kind=kind, when=when: r.withColumn(when, at("t")).drop("t")
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / name / "*"))
        frames.append((read(source), read(spark.createDataFrame(rows, kind))))
    (cell_stream, cell_rows), (strike_stream, strike_rows) = frames
    run = strikes_by_cell(cell_stream, strike_stream).writeStream.format("memory").queryName("beside").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(strikes_by_cell(cell_rows, strike_rows))
    assert rows(spark.table("beside")) == want and len(want) > 300
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in run.recentProgress if p["stateOperators"]]
    # A cell stands in nine places for up to the lateness, a strike in one for that and the window.
    assert len(held) > 8 and max(held) < 0.5 * (9 * len(cells) + len(strikes)) and held[-1] < 9 * 60 + 80


# Episodes


COMING = {"eta": 20, "nearest_km": 30.0, "pin_level": 0, "cell_level": 2, "will_hit": True, "approaching": True, "receding": False, "chance": 90}
OVER = {**COMING, "eta": 0, "nearest_km": 3.0, "pin_level": 2}


def trace(spark, *rows):
    """Rows of pins: (pin, minute, kind, columns)."""
    names = ["pin_id", "m", "kind", "lat", "lon", "eta", "nearest_km", "pin_level", "cell_level", "will_hit", "approaching", "receding", "chance", "lead_min", "enabled"]
    full = [tuple({"pin_id": pin, "m": float(minute), "kind": kind, **(COMING if kind == "threat" else {}), **more}.get(n) for n in names) for pin, minute, kind, more in rows]
    kinds = "pin_id long, m double, kind string, lat double, lon double, eta int, nearest_km double, pin_level int, cell_level int, will_hit boolean, approaching boolean, receding boolean, chance int, lead_min int, enabled boolean"
    return spark.createDataFrame(full, kinds).withColumn("ts", F.timestamp_seconds(1_704_067_200 + F.col("m") * 60)).withColumn("event_id", F.monotonically_increasing_id()).drop("m")


def kinds_of(found):
    return [(r["pin_id"], r["kind"], round((r["at"] - dt.datetime(2024, 1, 1, tzinfo=r["at"].tzinfo)).total_seconds() / 60)) for r in found.orderBy("pin_id", "at").collect()]


def test_what_ends_an_episode(spark):
    here, there = {"lat": 52.0, "lon": 21.0}, {"lat": 50.0, "lon": 20.0}
    rows = [
        (1, 0, "place", here), (1, 1, "threat", {}), (1, 5, "threat", {}), (1, 6, "place", there), (1, 7, "threat", {}),  # a moved pin is told anew
        (2, 0, "place", here), (2, 1, "threat", {}), (2, 40, "reload", here), (2, 41, "threat", {}),  # a reload in time keeps the episode
        (3, 0, "place", here), (3, 1, "threat", {}), (3, 47, "reload", here), (3, 48, "threat", {}),  # one after the TTL does not
        (4, 0, "place", here), (4, 1, "threat", {}), (4, 5, "reload", there), (4, 6, "threat", {}),  # nor does one of another place
        (5, 0, "settings", {"lead_min": 10}), (5, 1, "threat", {}), (5, 2, "settings", {"lead_min": 30}), (5, 3, "threat", {}), (5, 4, "settings", {"enabled": False}), (5, 5, "threat", OVER), (5, 6, "settings", {"enabled": True}), (5, 7, "threat", OVER),
        (6, 1, "threat", OVER), (6, 2 + 24 * 60, "threat", OVER),  # a day without a row
    ]
    got = kinds_of(episodes.replay(trace(spark, *rows)))
    assert got == [(1, "incoming", 1), (1, "incoming", 7), (2, "incoming", 1), (3, "incoming", 1), (3, "incoming", 48), (4, "incoming", 1), (4, "incoming", 6), (5, "incoming", 3), (5, "now", 7), (6, "now", 1), (6, "now", 2 + 24 * 60)]


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_the_stream_of_threats_and_changes_fires_what_the_replay_fires(spark, tmp_path, rocks):
    rows = SQ.pin_rows(Scene(spark, f"{DATA}/sf0.001")).cache()
    # In three parts by time, each stirred within the hour that the stream waits.
    days = rows.selectExpr("min(ts) as a", "max(ts) as b").first()
    for k in range(3):
        low, high = (days["a"] + (days["b"] - days["a"]) * f / 3 for f in (k, k + 1))
        part = rows.where((F.col("ts") >= low) & ((F.col("ts") < high) | F.lit(k == 2)))
        part.orderBy(F.rand(4)).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = episodes.stream(source).writeStream.format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = sorted(map(tuple, episodes.replay(rows).collect()))
    assert sorted(map(tuple, spark.table("episodes").collect())) == want != []


def test_a_pins_state_goes_with_its_timer(spark, tmp_path, rocks):
    rows = trace(spark, *[(pin, pin * 30 * 60, "threat", OVER) for pin in range(8)])
    for k, part in enumerate(rows.orderBy("ts").collect()):
        spark.createDataFrame([part], rows.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = episodes.stream(source).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert len(kinds_of(spark.table("timed"))) == 8
    # The watermark of a batch is that of the one before: no more than the last two or three pins are known at a time.
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) <= 3 and held[-1] <= 2


# Delivery


def events(spark, *rows):
    return spark.createDataFrame([(pin, event, hour) for pin, event, hour in rows], "pin_id long, event_id string, h int").select("pin_id", "event_id", F.timestamp_seconds(1_704_067_200 + F.col("h") * 3600).alias("at"), F.lit("now").alias("kind"), F.lit("t").alias("title"), F.lit("b").alias("body"))


def shown(spark, path):
    return sorted((r["pin_id"], r["event_id"], r["channel"]) for r in delivery.delivered(spark, path).collect())


def test_a_batch_delivered_twice_leaves_one_row(spark, tmp_path):
    path = str(tmp_path / "out")
    deliver = delivery.sink(path, 22, 6, "UTC")
    first = events(spark, (1, "a:now", 12), (1, "a:now", 12), (2, "a:now", 12), (3, "b:now", 23), (4, "c:now", 5))
    assert shown(spark, path) == []
    deliver(first, 0)
    want = [(1, "a:now", "banner"), (1, "a:now", "notice"), (2, "a:now", "banner"), (2, "a:now", "notice"), (3, "b:now", "banner"), (4, "c:now", "banner")]
    assert shown(spark, path) == want  # in the quiet hours the banner alone
    deliver(first, 0)
    assert shown(spark, path) == want
    deliver(events(spark, (1, "a:now", 12), (5, "d:now", 12)), 1)  # another batch says one of them again
    want = sorted([*want, (5, "d:now", "banner"), (5, "d:now", "notice")])
    assert shown(spark, path) == want
    deliver(events(spark, (9, "x:now", 12)).where("false"), 2)
    assert shown(spark, path) == want


def test_a_batch_that_failed_half_way_does_not_count(spark, tmp_path):
    path = str(tmp_path / "out")
    deliver = delivery.sink(path)
    deliver(events(spark, (1, "a:now", 12)), 0)
    deliver(events(spark, (2, "b:now", 12), (3, "c:now", 12)), 1)
    (tmp_path / "out" / "batch=1" / "_SUCCESS").unlink()
    assert {r[0] for r in shown(spark, path)} == {1}
    deliver(events(spark, (2, "b:now", 12), (3, "c:now", 12)), 1)
    assert {r[0] for r in shown(spark, path)} == {1, 2, 3} and len(shown(spark, path)) == 6


def test_a_stream_delivers_each_event_once(spark, tmp_path):
    rows = events(spark, *[(k % 5, f"{k % 20}:now", 8 + k % 20 % 5) for k in range(60)])
    for k in range(3):
        rows.orderBy("event_id").limit(40 + 10 * k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    path = str(tmp_path / "out")
    run = source.writeStream.foreachBatch(delivery.sink(path)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = shown(spark, path)
    assert len(got) == len(set(got)) and {(p, e) for p, e, _ in got} == {(r["pin_id"], r["event_id"]) for r in rows.collect()}


# Looks at all rows by Spark


def test_delivery_takes_one_run_of_the_replay(spark, monkeypatch):
    rows, replay = spark.sparkContext.accumulator(0), alerts.replay

    def counted(threats):
        def count(parts):
            for part in parts:
                rows.add(part.num_rows)
                yield part

        found = replay(threats)
        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(alerts, "replay", counted)
    told = SQ.alert_delivery(Scene(spark, f"{DATA}/sf0.001")).select("pin_id", "event_id").distinct().count()
    assert 0 < told <= rows.value == replay(SQ._lines(Scene(spark, f"{DATA}/sf0.001")).withColumnRenamed("level", "cell_level")).count()


def test_spark_looks_at_a_threat_as_the_step_does(spark):
    odd = random.Random(5)
    some = lambda *of: odd.choice(of)
    names = ["pin_id", "ts", "event_id", "radar_time", "eta", "nearest_km", "pin_level", "cell_level", "will_hit", "approaching", "receding", "chance", "timeline", "timeline_advected", "enabled", "lead_min", "min_level", "min_chance", "all_clear"]
    kinds = "pin_id long, ts double, event_id long, radar_time double, eta double, nearest_km double, pin_level int, cell_level int, will_hit boolean, approaching boolean, receding boolean, chance int, timeline array<struct<t:int,level:int,rate:double,unknown:boolean>>, timeline_advected boolean, enabled boolean, lead_min int, min_level int, min_chance int, all_clear boolean"
    now, rows = 1_704_067_200.25, []
    for n in range(1500):
        now += some(20, 61.5, 180, 400, 3000)
        line = some(None, [], [(t, odd.randrange(5), 1.0, odd.random() < 0.1) for t in range(0, 91, 15)])
        rows.append((
            7, now, n, some(now, now - 90, now - 1800, now - 1801, None, math.nan), some(None, math.nan, 0.0, 5.0, 20.0, 45.0), some(None, math.nan, 3.0, 8.0, 15.0, 30.0), odd.randrange(4), odd.randrange(5), some(True, False, None), some(True, False, False), some(True, False, False, None), some(30, 49, 50, 90), line, some(True, False, None),
            odd.random() < 0.95, some(30, 45), some(1, 2, 3), 50, odd.random() < 0.9,
        ))
    memory, want = alerts.Memory(), []
    for row in (dict(zip(names, r, strict=True)) for r in rows):
        line = row["timeline"] and [dict(zip(("t", "level", "rate", "unknown"), p, strict=True)) for p in row["timeline"]]
        event, memory, _ = alerts.step({**row, "timeline": line}, alerts.Settings(*(row[c] for c in ("enabled", "lead_min", "min_level", "min_chance", "all_clear"))), memory, row["ts"])
        want += [(row["ts"], event["kind"], None if event["eta"] is None else int(event["eta"]), event["level"], event["chance"])] if event else []
    threats = spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    seconds = F.unix_micros("at") / 1e6
    for zone in ("UTC", "Europe/Warsaw"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [tuple(r) for r in alerts.replay(threats).select(seconds, "kind", "eta", "level", "chance").orderBy("at").collect()]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == want and len(want) > 40 and {k for _, k, *_ in want} == {"incoming", "now", "allclear"}
