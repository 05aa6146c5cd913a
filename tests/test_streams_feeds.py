"""Alert episodes, their stream, feeds and matched cells on small scenes."""

from __future__ import annotations

from conftest import DATA
from pyspark.sql import functions as F

from pluvio.operators import growth
from pluvio.plans.fixtures import Scene
from pluvio.sources import feeds, wire
from pluvio.streaming import alerts

OVER = {"radar_time": 0, "eta": 0, "nearest_km": 3.0, "pin_level": 2, "cell_level": 2, "will_hit": True, "approaching": False, "receding": False, "chance": 90}
COMING = {**OVER, "eta": 20, "nearest_km": 30.0, "pin_level": 0, "approaching": True}
CLEAR = {**OVER, "eta": None, "nearest_km": None, "pin_level": 0, "cell_level": 0, "will_hit": False, "chance": 10}


def fired(*looks):
    memory, out = alerts.Memory(), []
    for threat, minute in looks:
        event, memory, _ = alerts.step({**threat, "radar_time": minute * 60}, alerts.Settings(), memory, minute * 60)
        out.append(event and event["kind"])
    return out


def test_an_episode_tells_each_stage_once():
    assert fired((COMING, 0), (COMING, 5), (OVER, 10), (OVER, 15), (CLEAR, 20), (CLEAR, 22), (CLEAR, 24), (CLEAR, 30)) == ["incoming", None, "now", None, None, None, "allclear", None]


def test_old_radar_changes_nothing():
    memory = alerts.Memory(episode=1.0, stage="incoming", qualified_at=1.0)
    assert alerts.step({**OVER, "radar_time": 0}, alerts.Settings(), memory, 31 * 60) == (None, memory, "stale")


def test_an_episode_fades_without_a_word():
    assert fired((COMING, 0), ({**CLEAR, "approaching": True}, 46), (COMING, 50)) == ["incoming", None, "incoming"]


def test_the_stream_fires_what_the_replay_fires(spark, tmp_path):
    trace = Scene(spark, f"{DATA}/sf0.001").threats().withColumn("ts", F.col("ts").cast("timestamp"))
    trace.repartition(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(trace.schema).parquet(str(tmp_path / "in"))
    run = alerts.stream(source).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("fired")) == rows(alerts.replay(trace)) != []


def test_rate_limit_counts_allowed_calls_alone(spark):
    calls = spark.createDataFrame([(1, s) for s in (0, 10, 20, 61, 65, 71)] + [(2, 0)], "client long, s long").select("client", F.timestamp_seconds("s").alias("ts"))
    got = {(r["client"], r["ts"].second + 60 * r["ts"].minute): r["allowed"] for r in alerts.rate_limited(calls, 2, 60).collect()}
    assert got == {(1, 0): True, (1, 10): True, (1, 20): False, (1, 61): True, (1, 65): False, (1, 71): True, (2, 0): True}


def test_strike_files_of_any_shape(spark):
    files = [("2026.08.31.12.51.ld.csv", "Szer;Dług;Czas\n52.1;21.5;2026-08-31 12:50:01\n99;1;x"), ("2026.08.31.12.52.ld.csv", "21.5,52.1\r\n\r\n"), ("2026.08.31.12.53.ld.csv", "<html>"), ("2026.08.31.12.54.ld.csv", None), ("odd", "52,21")]
    got = [(r["lat"], r["lon"], r["at"].strftime("%H:%M:%S")) for r in feeds.strikes(spark.createDataFrame(files, "name string, body string")).orderBy("at").collect()]
    assert got == [(52.1, 21.5, "12:50:01"), (52.1, 21.5, "12:52:00")]


def test_packed_frames_end_with_a_partial_record(spark):
    whole = spark.createDataFrame([(1, 52.123, 10.0, 3, 4.26), (1, 48.0, 20.0, 1, None)], "frame_time long, lat double, lon double, level int, rate double")
    packed = wire.pack(whole).withColumn("packed", F.base64(F.concat(F.unbase64("packed"), F.lit(b"abc"))))
    got = [tuple(round(x, 3) for x in r) for r in packed.select(F.inline(wire.unpack(F.col("packed")))).collect()]
    assert got == [(52.123, 11.0, 3, 4.3), (48.0, 20.0, 1, 0.0)]
    assert spark.range(1).select(F.size(wire.unpack(F.lit(None).cast("string"))).alias("n")).first()["n"] == 0


def test_cells_match_one_to_one(spark):
    trails = spark.createDataFrame([(300, 1, 0, 1), (300, 1, 300, 2)], "scan_time long, trail_id long, frame_time long, mass_id long")
    members = spark.createDataFrame([(0, 1, 52.0, 20.0, 1, 1.0), (0, 1, 52.0, 20.05, 1, 2.0), (300, 2, 52.1, 20.1, 1, 3.0), (300, 2, 52.1, 20.15, 1, 5.0)], "frame_time long, mass_id long, lat double, lon double, level int, rate double")
    got = sorted((r["i"], r["j"], r["change"]) for r in growth.matched_cells(trails, members).collect())
    assert got == [(1, 1, 2.0), (2, 2, 3.0)]


def test_a_downpour_behind_drizzle_is_told(spark):
    """Drizzle is over the pin already; what was asked for comes in twenty minutes, by the timeline."""
    line = [{"t": t, "level": 3 if t >= 20 else 1, "rate": 1.0, "unknown": False} for t in range(0, 91, 5)]
    seen = {**OVER, "pin_level": 1, "cell_level": 3, "timeline": line, "timeline_advected": True}
    event, memory, why = alerts.step(seen, alerts.Settings(min_level=3, lead_min=30), alerts.Memory(), 0.0)
    assert (event["kind"], event["eta"], event["level"], why) == ("incoming", 20, 3, "fired")
    assert alerts.step({**seen, "timeline_advected": False, "eta": 0}, alerts.Settings(min_level=3), alerts.Memory(), 0.0)[0] is None
    late = [{**p, "level": 0, "unknown": p["t"] > 40} for p in line]
    assert alerts.eta_to_level({**seen, "timeline": late, "eta": 35}, 3) == 35 and alerts.eta_to_level({**seen, "timeline": [{**p, "level": 0} for p in line], "eta": 35}, 3) is None


def test_an_eta_that_wavers_about_the_lead_is_one_episode():
    cell = lambda eta: {**COMING, "eta": eta, "nearest_km": 35.0, "cell_level": 3}
    assert fired((cell(28), 0), (cell(32), 3), (cell(32), 6), (cell(29), 8)) == ["incoming", None, None, None]


def test_events_have_words_and_pins_settings_of_their_own(spark):
    rows = [(1, 0, 25, 30.0, 0, "Kraków", "zachodu", "wschód", 40.0, 30), (1, 600, 0, 2.0, 2, "Kraków", "zachodu", "wschód", 40.0, 30), (1, 1200, None, None, 0, "Kraków", None, "wschód", None, 30), (1, 1500, None, None, 0, "Kraków", None, "wschód", None, 30), (2, 0, 25, 30.0, 0, "Dom", None, None, None, 20)]
    threats = spark.createDataFrame(rows, "pin_id long, s long, eta int, nearest_km double, pin_level int, label string, coming_from string, toward string, speed_kmh double, lead_min int").withColumns({
        "ts": F.timestamp_seconds("s"), "cell_level": F.lit(2), "will_hit": F.col("eta").isNotNull(), "approaching": F.lit(False), "receding": F.lit(False), "chance": F.lit(70), "expect": F.when(F.col("eta") == 0, "deszczu i mokrej jezdni"),
    })
    got = [(r["kind"], r["title"], r["body"], r["event_id"]) for r in alerts.replay(threats).orderBy("at").collect()]
    assert got == [
        ("incoming", "Deszcz za ok. 25 min", "Idzie od zachodu (~40 km/h) na Kraków. Szansa ~70%. Radar 01:00 · sprzed 0 min.", "0:incoming"),
        ("now", "Deszcz nad Krakowem", "Opad jest nad pinezką teraz. Spodziewaj się: deszczu i mokrej jezdni. Radar 01:10 · sprzed 0 min.", "0:now"),
        ("allclear", "Przeszło · Kraków", "Opad odszedł na wschód. Radar czysty w promieniu 20 km. Radar 01:25 · sprzed 0 min.", "0:allclear"),
    ]


def test_a_source_that_fails_leaves_the_others(spark):
    assert feeds.attempt(lambda: spark.read.parquet("/tmp/nowhere-at-all")) is None
    assert feeds.attempt(lambda: spark.range(3)).count() == 3


def test_frames_are_polled_as_they_come(spark, tmp_path):
    from pluvio.sources import polling

    rows = [(300 * k, 52.0, 20.0 + k, 1 + k % 3, 1.0, 3.0) for k in range(30)]
    spark.createDataFrame(rows, polling.SAMPLES).repartition(3).write.parquet(str(tmp_path / "in"))
    run = polling.frames_seen(polling.poll(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    # A source in Python is read once by availableNow, without the batch after it in which the watermark counts.
    run.processAllAvailable()
    run.stop()
    got = {(r["frame_time"], r["n"]) for r in spark.table("frames").collect()}
    assert got <= {(r[0], 1) for r in rows} and len(got) >= 20 and polling.trigger() == {"processingTime": "90 seconds"}


def test_growth_of_matched_cells(spark):
    pairs = spark.createDataFrame([(9, 1, 300, 5.0, 1, 1, 0.1, 2.0), (9, 1, 300, 5.0, 2, 2, 0.1, 4.0), (9, 1, 600, 5.0, 1, 1, 0.1, -1.0), (9, 2, 300, 5.0, 1, 1, 0.1, 0.5)], growth.PAIRS)
    got = {r["trail_id"]: (r["delta"], r["slope"]) for r in growth.growth(pairs).collect()}
    assert got == {1: (5.0, (3.0 - 1.0) / 10.0), 2: (0.5, 0.1)}
