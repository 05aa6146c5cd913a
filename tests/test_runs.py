"""A hindcast's run and summary, motions that are known, sources that fail, and the small rules."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_threat import CITY, at, blob, scene, turn

from pluvio.operators import alert_rules as R
from pluvio.operators import growth as G
from pluvio.operators import threat as TH
from pluvio.operators import trails as T
from pluvio.operators import verify as V
from pluvio.operators import warnings as W
from pluvio.operators.stages import written
from pluvio.sources import feeds

T0 = 1_777_766_000


@pytest.fixture(scope="module")
def run(spark):
    """One scored scan. A cell comes to the first pin and goes out on the way; rain springs up over the second without a sign; the third lies under rain that stays; nothing is near the fourth."""
    frames = []
    for i in range(10):
        cells = blob(53.6, 16.0, 2)
        cells += blob(50.0, 20.25 + 0.15 * i) if i <= 3 else []
        cells += blob(52.0, 18.0) if i >= 4 else []
        cells += blob(52.6, 18.6, 1)  # far from the second pin, so that it counts
        frames.append((T0 + 600 * i, cells))
    rows = scene(spark, *frames)
    pins = spark.createDataFrame([(1, "comes", *CITY), (2, "springs", 52.0, 18.0), (3, "stays", 53.6, 16.0), (4, "none", 49.2, 24.0)], "pin_id long, label string, lat double, lon double")
    scans = T.rolling_scans(rows).join(V.scored_frames(rows).withColumnRenamed("frame_time", "scan_time"), "scan_time", "left_semi")
    return rows, V.hindcast(written(TH.threats(TH.echo(rows, scans), pins)), written(V.observed_at_leads(rows, pins)))


def test_a_miss_and_a_false_alarm(run):
    _, h = run
    alerts = {(r["config"], r["thr"]): r for r in h.alerts.collect()}
    for key in (("research", 1), ("research", 2), ("shipped", 2)):
        assert alerts[key]["fa"] == 1, key
    assert alerts["research", 1]["miss"] == alerts["research", 2]["miss"] == alerts["shipped", 2]["miss"] == 1
    assert alerts["research", 1]["hit"] == 0 and alerts["research", 1]["far"] == 1.0 and alerts["research", 1]["n_bias"] is None
    now = {(r["thr"], r["lead"]): r for r in h.nowcast.collect()}
    # The rain that stays is a hit at each lead, that which springs up a miss, that which goes out a false alarm when it should come.
    assert all(now[1, lead]["hit"] >= 1 and now[1, lead]["miss"] == 1 for lead in (10, 20, 30, 40, 50, 60)) and max(now[1, lead]["fa"] for lead in (10, 20, 30)) == 1


def test_the_summary_holds_the_run_and_its_scores(run):
    rows, h = run
    facts = V.run_facts(rows, F.lit(T0 + 9 * 600 + 90))
    got = json.loads(V.summary(h, facts, F.timestamp_seconds(F.lit(T0 + 10_000))).first()["summary"])
    n = sorted(r["count"] for r in rows.groupBy("frame_time").count().collect())
    iso = lambda t: F.date_format(F.timestamp_seconds(F.lit(t)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    want = rows.sparkSession.range(1).select(iso(T0), iso(T0 + 5400)).first()
    assert got["radar"] == {"from": want[0], "to": want[1], "frames": 10, "latestAgeSec": 90} and got["date"] == want[1][:10]
    assert got["cellKm"] == [3.0] and got["sampleCount"] == {"min": n[0], "max": n[-1]}
    assert got["motion"]["allCases"] == 4 and got["motion"]["echoCases"] == 3
    assert set(got["nowcast"]) == set(got["persist"]) == {"1", "2"} and list(got["nowcast"]["1"]) == ["10", "20", "30", "40", "50", "60"]
    assert got["alerts"]["shipped"]["leadMin"] == 30 and got["alerts"]["shipped"]["skill"]["fa"] == 1 and got["alerts"]["shipped"]["etaBiasMin"] is None
    assert got["alerts"]["research"]["byThreshold"]["1"]["skill"]["n"] == got["alerts"]["research"]["byThreshold"]["1"]["skill"]["hit"] + 1 + 1 + got["alerts"]["research"]["byThreshold"]["1"]["skill"]["cn"]
    assert [b["bucket"] for b in got["szansa"]] == ["0-19", *(f"{x}-{x + 9}" for x in range(20, 90, 10)), "90-100"] and sum(b["n"] for b in got["szansa"]) == 3
    assert json.loads(V.summary(h, V.run_facts(rows), F.timestamp_seconds(F.lit(T0))).first()["summary"])["radar"]["latestAgeSec"] is None


@pytest.mark.parametrize(("bearing", "speed"), [(90, 40), (20, 30), (225, 60)])
def test_the_motion_of_a_mass_is_that_which_moved_it(spark, bearing, speed):
    """Within a tenth, and five degrees."""
    frames = []
    for i in range(5):
        a, b = at(52.0, 19.5, bearing, speed * i / 6)
        frames.append((600 * i, [(a + r * 0.027, b + c * 0.044, 4 - max(abs(r), abs(c))) for r in range(-3, 4) for c in range(-3, 4) if max(abs(r), abs(c)) < 4]))
    rows = scene(spark, *frames).withColumn("ncc_cell_km", F.lit(2.0))
    found = TH.mass_motion(TH.echo(rows, T.one_scan(rows))).collect()
    assert len(found) == 1
    assert abs(found[0]["speed"] - speed) <= 0.1 * speed and abs((found[0]["bearing"] - bearing + 180) % 360 - 180) <= 5
    assert abs((turn(found[0]["from_lat"], found[0]["from_lon"], *at(52.0, 19.5, bearing, 4 * speed / 6)) - bearing + 180) % 360 - 180) <= 5


# Sources


def broken(spark, at_row):
    return spark.range(1000, numPartitions=8).withColumn("x", F.when(F.col("id") == at_row, F.raise_error(F.lit("cut off")).cast("long")).otherwise(F.col("id"))).where("x >= 0")


def test_a_source_that_fails_late_fails(spark):
    assert feeds.attempt(lambda: broken(spark, 999)) is None
    assert feeds.attempt(lambda: broken(spark, -1)).count() == 1000


def test_the_preferred_sources_error_is_raised_where_both_fail(spark):
    good = spark.range(5).withColumn("x", F.col("id"))
    assert feeds.first_that_works(lambda: broken(spark, 3), lambda: good).count() == 5
    assert feeds.first_that_works(lambda: good, lambda: broken(spark, 3)).count() == 5
    with pytest.raises(PySparkException, match="cut off"):
        feeds.first_that_works(lambda: broken(spark, 999), lambda: spark.read.parquet("/nowhere/at/all"))
    with pytest.raises(ValueError):
        feeds.first_that_works()


# Small rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cells_by_count(spark):
    for n, km in ((0, 3.0), (9000, 3.0), (9001, 6.0), (36_000, 6.0), (36_001, 12.0), (144_001, 24.0), (10**7, 24.0)):
        factor, cells = 1, n
        while cells > 9000 and factor < 8:
            factor, cells = factor * 2, math.ceil(n / (factor * 2) ** 2)
        assert one(spark, V.cell_km_of_count(F.lit(n))) == km == 3.0 * factor


def test_labels_cursors_gates(spark):
    assert [one(spark, W.county_label(F.lit(x))) for x in ("otwocki", "powiat otwocki", "powiatowy")] == ["powiat otwocki", "powiat otwocki", "powiat powiatowy"]
    assert [one(spark, R.now_cursor(F.lit(x))) for x in (-5.0, 0.0, 45.0, 90.0, 400.0)] == [0.0, 0.0, 0.5, 1.0, 1.0] and one(spark, R.now_cursor(F.lit(5.0), 0)) == 0.0
    assert [one(spark, G.gate_passes(F.lit(x))) for x in (0, 2, 3, 9)] == [False, False, True, True]


def test_maps_show_arrows_only_where_they_were_asked_for(spark):
    drawn = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "scan_time long, trail_id long")
    toggles = spark.createDataFrame([(1, True), (2, False), (3, None), (1, True)], "scan_time long, shown boolean")
    assert [r["scan_time"] for r in TH.tracks_on_map(drawn, toggles).collect()] == [1]


def test_lanes_follow_the_feed(spark):
    warnings = spark.createDataFrame([(9, 0, "Burze", True, ["0205"], "2030-01-01"), (1, 1, "Grad", True, ["0205", "0206", "0206"], "2030-01-01"), (2, 2, "Burze", True, ["0206"], "2030-01-01"), (3, 0, "Upał", False, ["0207"], "2030-01-01"), (4, 0, "Burze", True, ["0208"], "2020-01-01")], "id long, ordinal long, event string, storm boolean, teryt array<string>, e string").withColumn("ends", F.to_timestamp("e"))
    pins = spark.createDataFrame([(1, "0205", "otwocki"), (2, "0206", "powiat inny"), (3, "0207", "x"), (4, "0208", "y"), (5, "0205", "otwocki")], "pin_id long, terc string, county string")
    got = {r["pin_id"]: (r["id"], r["lane"]) for r in W.lanes(pins, warnings, F.to_timestamp(F.lit("2025-01-01"))).collect()}
    assert got == {1: (9, "Ostrzeżenie IMGW: burze · powiat otwocki"), 2: (1, "Ostrzeżenie IMGW: grad · powiat inny"), 5: (9, "Ostrzeżenie IMGW: burze · powiat otwocki")}


def test_sentences_and_what_they_say_again(spark):
    text = "Idzie od zachodu. Komórka rośnie, echo ok. 13 km. Szansa na to wynosi ~60%. Opad jest tu teraz! Minie 5 km obok. Łagodnie? Koniec."
    assert one(spark, R.sentences(F.lit(text))) == ["Idzie od zachodu.", "Komórka rośnie, echo ok. 13 km.", "Szansa na to wynosi ~60%.", "Opad jest tu teraz!", "Minie 5 km obok.", "Łagodnie?", "Koniec."]
    assert one(spark, R.caveat(F.lit(text))) == "Komórka rośnie, echo ok. 13 km. Koniec."
    assert one(spark, R.caveat(F.lit("Szansa mała. To jest ~5 % szansa."))) == "Szansa mała. To jest ~5 % szansa." and one(spark, R.caveat(F.lit("Echo 5 km."))) is None
    for said, offline in (("TypeError: Failed to FETCH", True), ("net::ERR_NETWORK_CHANGED", True), ("HTTP 500", False), (None, False)):
        assert one(spark, R.is_offline(F.lit(True), F.lit(True), F.lit(said).cast("string"))) is offline
