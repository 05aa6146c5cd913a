"""Motion, threats and their verification: against plain numpy, and on scenes with a known answer."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from pluvio.operators import advect as A
from pluvio.operators import motion as N
from pluvio.operators import threat as TH
from pluvio.operators import trails as T
from pluvio.operators import verify as V
from pluvio.operators.spatial import range_join
from pluvio.operators.stages import written
from pluvio.plans import catalog
from pluvio.plans import mass_queries as MQ
from pluvio.plans import motion_queries as MOQ
from pluvio.plans.fixtures import Scene
from pluvio.plans.grid_queries import samples

SMALL = f"{DATA}/sf0.001"
CITY = (50.0, 21.0)
R = 6371.0


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def at(lat, lon, turn, d):
    a, b, t = math.radians(lat), math.radians(lon), math.radians(turn)
    up = math.asin(math.sin(a) * math.cos(d / R) + math.cos(a) * math.sin(d / R) * math.cos(t))
    return math.degrees(up), math.degrees(b + math.atan2(math.sin(t) * math.sin(d / R) * math.cos(a), math.cos(d / R) - math.sin(a) * math.sin(up)))


def turn(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return math.degrees(math.atan2(math.sin(d - b) * math.cos(c), math.cos(a) * math.sin(c) - math.sin(a) * math.cos(c) * math.cos(d - b))) % 360


def blob(lat, lon, level=3, half=2, step=0.04):
    return [(lat + i * step, lon + j * step, level) for i in range(-half, half + 1) for j in range(-half, half + 1)]


def scene(spark, *frames):
    """Frames as (time, cells)."""
    rows = [(t, lat, lon, level, [0.0, 0.1, 1.0, 4.0, 10.0][level], 3.0) for t, cells in frames for lat, lon, level in cells]
    return spark.createDataFrame(rows, "frame_time long, lat double, lon double, level int, rate double, cell_km double")


def two_motions():
    """The nearer mass goes north, the other comes from the west."""
    out = []
    for i in range(4):
        a, b = at(*CITY, 0, 20 + 4 * i), at(*CITY, 270, 60 - i * 20 / 3)
        out.append((600 * i, blob(*a, step=0.025) + blob(*b, step=0.025)))
    return out


STORMS = ((20.55, 20.4), (20.68, 20.55), (20.82, 20.7), (20.95, 20.85))
OVERHEAD = [(1000, blob(50.0, 20.95, 4)), (1600, blob(50.0, 21.0, 4))]
FAR_RAIN = [(1000, blob(52.5, 16.0, 2)), (1600, blob(52.5, 16.1, 2))]
#: Each scene's frames, and from when to when and of what kind a warning holds, in seconds of the scene.
SCENES = {
    "west": ([(1000, blob(50.0, 20.4)), (1600, blob(50.0, 20.55))], None), "over": ([(1000, blob(50.0, 21.0, 2)), (1600, blob(50.02, 21.03, 2))], None), "passing": ([(1000, blob(50.85, 20.5, 2)), (1600, blob(50.85, 20.65, 2))], None),
    "far": ([(1000, blob(50.0, 25.3, 4)), (1600, blob(50.0, 25.45, 4))], None), "near_and_far": ([(1000, blob(50.0, 20.4, 2) + blob(50.0, 25.3, 4)), (1600, blob(50.0, 20.55, 2) + blob(50.0, 25.45, 4))], None),
    "storms": ([(600 * i, blob(50.0, a) + blob(50.7, b)) for i, (a, b) in enumerate(STORMS)], None), "motions": (two_motions(), None), "lightning": (OVERHEAD, (0, 9000, True)), "plain": (OVERHEAD, None),
    "warned": (FAR_RAIN, (0, 9000, True)), "later": (FAR_RAIN, (90_000, 99_000, True)), "heat": (FAR_RAIN, (0, 9000, False)),
}


@pytest.fixture(scope="module")
def threats(spark):
    """All scenes at once, as scans far apart in time: the threat of the one pin, and the arrows."""
    base = {name: 1_000_000 * (i + 1) for i, name in enumerate(SCENES)}
    rows = scene(spark, *[(base[name] + t, cells) for name, (frames, _) in SCENES.items() for t, cells in frames])
    scans = spark.createDataFrame([(base[name] + frames[-1][0], base[name] + t) for name, (frames, _) in SCENES.items() for t, _ in frames], "scan_time long, frame_time long")
    e = TH.echo(rows, scans)
    pins = spark.createDataFrame([(1, "Dom", *CITY, "1261")], "pin_id long, label string, lat double, lon double, terc string")
    # A pin of its own county for each scene would be the same; the windows are too far apart to touch another scene.
    held = [(i, 3, base[name] + w[0], base[name] + w[1], w[2], ["1261"], "Burze.") for i, (name, (_, w)) in enumerate(SCENES.items()) if w]
    warnings = spark.createDataFrame(held, "id long, degree int, a long, b long, storm boolean, teryt array<string>, body string").select("id", "degree", F.timestamp_seconds("a").alias("starts"), F.timestamp_seconds("b").alias("ends"), "storm", "teryt", "body")
    strikes = spark.createDataFrame([(base["lightning"] + 1600, 50.05, 21.0)], "scan_time long, lat double, lon double")
    of = {base[name] + frames[-1][0]: name for name, (frames, _) in SCENES.items()}
    moving = TH.moving_masses(e)
    found = {of[r["scan_time"]]: r for r in TH.threats(e, pins, strikes=strikes).collect()}
    warned = {of[r["scan_time"]]: r for r in TH.threats(e, pins, warnings=warnings).collect()}
    tracks = {}
    for r in TH.tracks(moving).orderBy("scan_time", "place").collect():
        tracks.setdefault(of[r["scan_time"]], []).append(r)
    return found, warned, tracks


# The array kernel, restated shift by shift and cell by cell.


def brute_pair(prev, now, lat, lon, hours, size):
    half = max(8, round(60 / size))
    n = 2 * half

    def raster(points):
        out = np.zeros((n, n))
        for a, b, level in points:
            x, y = math.floor((b - lon) / (size / (111 * max(math.cos(math.radians(lat)), 0.25))) + 0.5) + half, math.floor((a - lat) / (size / 111) + 0.5) + half
            if 0 <= x < n and 0 <= y < n:
                out[y, x] = max(out[y, x], level)
        return out

    def boxed(g, r):
        return np.array([[g[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].mean() for x in range(n)] for y in range(n)])

    a, b = raster(prev), raster(now)
    if min((a > 0).sum(), (b > 0).sum()) < 4:
        return None
    r = 3 if size >= 3 else max(1, math.floor(9 / size + 0.5))
    a, b = boxed(a, r), boxed(b, r)

    def score(dx, dy):
        p, q = [], []
        for y in range(n):
            for x in range(n):
                if 0 <= x + dx < n and 0 <= y + dy < n and (a[y, x] > 1e-12 or b[y + dy, x + dx] > 1e-12):
                    p.append(a[y, x])
                    q.append(b[y + dy, x + dx])
        if len(p) < 10 or np.var(p) * len(p) <= 1e-6 or np.var(q) * len(q) <= 1e-6:
            return -1.0
        return float(np.corrcoef(p, q)[0, 1]) * (n - abs(dx)) * (n - abs(dy)) / n**2

    most = max(1, min(24, n * 2 // 6, math.ceil(min(95 * hours, 70) / size)))
    step = 2 if most > 6 else 1
    reach = range(-most, most + 1, step)
    scored = [(score(dx, dy), dx, dy) for dy in reach for dx in reach]
    best = max(scored, key=lambda s: s[0])
    if step > 1:
        near = [(score(best[1] + i, best[2] + j), best[1] + i, best[2] + j) for j in (-1, 0, 1) for i in (-1, 0, 1) if max(abs(best[1] + i), abs(best[2] + j)) <= most]
        best = max([best, *near], key=lambda s: s[0])
    return best


@pytest.mark.parametrize("size", [3.0, 2.0])
def test_pair_motion_equals_brute_force(size):
    import pandas as pd

    rng = np.random.default_rng(3)
    cells = [(50 + rng.normal() * 0.12, 21 + rng.normal() * 0.15, int(rng.integers(1, 5))) for _ in range(70)]
    moved = [(*at(a, b, 60.0, 9.0), level) for a, b, level in cells]
    frame = lambda points: pd.DataFrame(points, columns=["lat", "lon", "level"])
    found = N.pair_motion(frame(cells), frame(moved), 50.0, 21.0, 1 / 6, size)
    best, dx, dy = brute_pair(cells, moved, 50.0, 21.0, 1 / 6, size)
    assert found is not None and found[3] == pytest.approx(best, abs=1e-9)
    speed, bearing, distance, _ = found
    east, north = distance * math.sin(math.radians(bearing)) / size, distance * math.cos(math.radians(bearing)) / size
    assert abs(east - dx) <= 0.52 and abs(north - dy) <= 0.52 and speed == pytest.approx(distance * 6)
    assert abs(distance - 9) < 2.5 * size and abs((bearing - 60 + 180) % 360 - 180) < 25


def test_registered_motions_agree_with_the_kernel(spark):
    """Each row of pair_motion and system_motion against the kernel called by hand on the same samples."""
    rows = samples(Scene(spark, SMALL), peaked=True).toPandas()
    frames = {t: g for t, g in rows.groupby("frame_time")}
    times = sorted(frames)
    pairs = {r["pair"]: r for r in catalog.queries()["pair_motion"](spark, SMALL).collect()}
    for a, b in zip(times, times[1:], strict=False):
        want = N.system_motion([(a, frames[a]), (b, frames[b])], 51.5, 19.2, 3.0)
        assert (b in pairs) == (want is not None)
        if want:
            assert (pairs[b]["speed"], pairs[b]["bearing"]) == (pytest.approx(want[0]), pytest.approx(want[1]))
    found = catalog.queries()["system_motion"](spark, SMALL).collect()
    assert found and all(1 <= r["speed"] <= 95 and 0 <= r["bearing"] < 360 and 40 <= r["confidence"] <= 95 for r in found)


def test_mass_motion_follows_blobs_that_move_evenly(spark):
    """Masses of the scene move by given steps a frame; the found motion is that, and each is one of the frame's masses."""
    s = Scene(spark, SMALL)
    found = {r["trail_id"]: r for r in TH.mass_motion(_echo_of(s)).collect()}
    trails = {}
    for r in MQ._trails(s).orderBy("frame_time").collect():
        trails.setdefault(r["trail_id"], []).append(r)
    assert found and set(found) <= set(trails)
    for i, r in found.items():
        first, last = trails[i][0], trails[i][-1]
        moved = km(first["lat"], first["lon"], last["lat"], last["lon"])
        own = moved / ((last["frame_time"] - first["frame_time"]) / 3600)
        assert (r["from_lat"], r["from_lon"]) == (pytest.approx(first["lat"]), pytest.approx(first["lon"]))
        assert 0.3 * own <= r["speed"] <= 3 * own + 5 and abs((r["bearing"] - turn(first["lat"], first["lon"], last["lat"], last["lon"]) + 180) % 360 - 180) < 45


def _echo_of(s):
    from pluvio.plans.motion_queries import _echo

    return _echo(s)


def test_cells_match_greedily(spark):
    """lagrangian_pairs against the closest pair first, then the closest of what is left, in plain Python."""
    s = Scene(spark, SMALL)
    members, trails = {}, {}
    for r in MQ._members(s).collect():
        members.setdefault((r["frame_time"], r["mass_id"]), []).append((r["lat"], r["lon"], r["rate"]))
    for r in MQ._trails(s).collect():
        trails.setdefault(r["trail_id"], []).append((r["frame_time"], r["mass_id"]))
    want = set()
    for trail, snaps in trails.items():
        cells = [(t, sorted(members[t, m])) for t, m in sorted(snaps)]
        for (_, before), (t, now) in zip(cells, cells[1:], strict=False):
            mean = lambda cs, k: sum(c[k] for c in cs) / len(cs)
            dy, dx = mean(now, 0) - mean(before, 0), mean(now, 1) - mean(before, 1)
            near = sorted((round(km(a[0], a[1], b[0] + dy, b[1] + dx), 9), i, j) for i, a in enumerate(now, 1) for j, b in enumerate(before, 1) if km(a[0], a[1], b[0] + dy, b[1] + dx) <= 6.5)
            seen_i, seen_j = set(), set()
            for _, i, j in near:
                if i not in seen_i and j not in seen_j:
                    seen_i.add(i)
                    seen_j.add(j)
                    want.add((trail, t, i, j, round(now[i - 1][2] - before[j - 1][2], 6)))
    got = {(r["trail_id"], r["frame_time"], r["i"], r["j"], round(r["change"], 6)) for r in catalog.queries()["lagrangian_pairs"](spark, SMALL).collect()}
    assert want and len(got & want) >= 0.99 * len(want) and len(got) == len(want)  # ties at the ninth digit may fall either way


# Scenes


def test_a_cell_from_the_west_arrives(threats):
    t, tracks = threats[0]["west"], threats[2]["west"]
    assert tracks and tracks[0]["threatening"]
    assert (t["coming_from"], t["toward"], t["will_hit"]) == ("zachodu", "wschód", True) and 0 < t["eta"] <= 50
    assert "Idzie od zachodu" in t["detail"] and "Dojście nad Twoją pinezką" in t["detail"] and ("deszcz" in t["expect"] or "ulew" in t["expect"])
    assert t["timeline_advected"] and len(t["timeline"]) == 19


def test_rain_over_the_pin_is_now(threats):
    t = threats[0]["over"]
    assert (t["eta"], t["will_hit"], t["level"]) == (0, True, "now") and "teraz" in t["detail"]


def test_a_cell_that_passes_is_no_hit(threats):
    t = threats[0]["passing"]
    assert threats[2]["passing"] and not t["will_hit"] and t["nearest_km"] <= 100 and t["coming_from"] is None


def test_a_far_cell_is_no_threat(threats):
    t = threats[0]["far"]
    assert (t["will_hit"], t["coming_from"], t["nearest_km"], t["expect"], t["level"]) == (False, None, None, None, "clear") and "100 km" in t["detail"]


def test_the_near_cell_speaks_for_the_pin(threats):
    t, tracks = threats[0]["near_and_far"], threats[2]["near_and_far"]
    assert t["coming_from"] == "zachodu" and t["will_hit"] and t["nearest_km"] < 50 and km(t["now_lat"], t["now_lon"], *CITY) <= 105
    assert len(tracks) == 2 and [r["confidence"] for r in tracks] == sorted((r["confidence"] for r in tracks), reverse=True)


def test_two_storms_have_two_arrows(threats):
    tracks = threats[2]["storms"]
    lats = sorted(r["now_lat"] for r in tracks)
    assert len(tracks) == 2 and lats[1] - lats[0] > 0.4 and [r["threatening"] for r in tracks] == [True, False]


def test_two_motions_and_the_field_between(threats):
    """What counts is the motion at each place, not that of the nearest mass."""
    t = threats[0]["motions"]
    assert len(threats[2]["motions"]) == 2 and t["will_hit"] and 25 <= t["eta"] <= 70 and not t["receding"]


def test_lightning_makes_a_storm(threats):
    assert threats[0]["lightning"]["lightning_near_cell"] and threats[0]["lightning"]["title"] == "Burza nad Tobą" and "gradu" not in threats[0]["lightning"]["expect"]
    assert not threats[0]["plain"]["lightning_near_cell"] and threats[0]["plain"]["title"] == "Ulewa nad Tobą"


def test_warnings_watch(threats):
    """Every warning of the pin's county counts in every scan: one that is over or to come as upcoming, one of heat not at all."""
    warned = threats[1]
    assert warned["warned"]["level"] == "watch" and warned["warned"]["detail"].startswith("Burze. Dla Dom") and warned["warned"]["chance"] == 45
    assert warned["later"]["level"] == warned["heat"]["level"] == "watch" and warned["later"]["chance"] == warned["heat"]["chance"] == 10
    assert all(threats[0][x]["level"] == "clear" for x in ("warned", "later", "heat"))


def test_hail_at_the_pin(spark):
    hail = scene(spark, *OVERHEAD).withColumn("rate", F.lit(120.0))
    pins = spark.createDataFrame([(1, "Dom", *CITY)], "pin_id long, label string, lat double, lon double")
    assert "gradu" in TH.threats(TH.echo(hail, T.one_scan(hail)), pins).first()["expect"]


@pytest.mark.parametrize("cell", [3.0, 6.0, 12.0])
def test_the_timeline_against_plain_loops(spark, cell):
    """Every sample carried by the motion of its place, for a field of two anchors on cells of some size; step by step."""
    rng = np.random.default_rng(5)
    cells = [(50 + rng.normal() * 0.3, 20.6 + rng.normal() * 0.3, int(rng.integers(1, 5))) for _ in range(120)]
    anchors = [(50.2, 20.3, 30.0, 10.0), (49.8, 20.9, 20.0, -15.0)]
    rows = scene(spark, (0, cells))
    field = spark.createDataFrame([(0, *a) for a in anchors], "frame_time long, lat double, lon double, u double, v double")
    pin = spark.createDataFrame([(0, 1, *CITY, (25.0, 0.0), True)], "frame_time long, pin_id long, pin_lat double, pin_lon double, background struct<u:double,v:double>, moving boolean").withColumn("field_km", F.lit(cell))

    def motion(lat, lon):
        lat_step, lon_step = cell / 111, cell / (111 * math.cos(math.radians(CITY[0])))
        ix, iy = math.floor((lon - CITY[1]) / lon_step + 0.5) + 20, math.floor((lat - CITY[0]) / lat_step + 0.5) + 20
        if 0 <= ix < 40 and 0 <= iy < 40:
            lat, lon = CITY[0] + (iy - 20) * lat_step, CITY[1] + (ix - 20) * lon_step
        near = [(1 / (km(lat, lon, a, b) ** 2 + 1), u, v) for a, b, u, v in anchors if km(lat, lon, a, b) <= 80]
        return (sum(w * u for w, u, _ in near) / sum(w for w, _, _ in near), sum(w * v for w, _, v in near) / sum(w for w, _, _ in near)) if near else (25.0, 0.0)

    def moved(lat, lon, m, t, back=False):
        return at(lat, lon, (math.degrees(math.atan2(*m)) + (180 if back else 0)) % 360, math.hypot(*m) * t / 60)

    got = {r["t"]: r["rate"] for r in A.timeline(rows, pin, field).collect()}
    rate = [0.0, 0.1, 1.0, 4.0, 10.0]
    for t in range(0, 91, 5):
        place = CITY
        for _ in range(3 if t else 0):
            place = moved(*CITY, motion(*place), t, back=True)
        reach = 6 + min(0.15 * km(*CITY, *place), 6)
        own = [rate[level] for a, b, level in cells if km(a, b, *CITY) <= 108 and km(*(moved(a, b, motion(a, b), t) if t else (a, b)), *CITY) <= reach]
        assert got[t] == pytest.approx(math.floor((sum(own) / len(own) if own else 0) * 10 + 0.5) / 10), t


def test_threats_look_at_the_field_of_their_own_cells(spark):
    """A scan on wide cells has its field on them: where two masses part, the timeline is that of plain ``timeline`` at the scan's size, and another than at 3 km."""
    frames = two_motions()
    pins = spark.createDataFrame([(1, "Dom", *CITY)], "pin_id long, label string, lat double, lon double")
    lines = {}
    for cell in (3.0, 12.0):
        rows = scene(spark, *frames).withColumn("cell_km", F.lit(cell)).withColumn("ncc_cell_km", F.lit(2.0))
        e = TH.echo(rows, T.one_scan(rows))
        assert TH.cell_km(e).first()["cell_km"] == cell
        moving = TH.moving_masses(e)
        u, v = A.geo.to_uv(F.col("bearing"), F.col("speed"))
        anchors = moving.select(F.col("scan_time").alias("frame_time"), "lat", "lon", u.alias("u"), v.alias("v"))
        found = TH.threats(e, pins).first()
        regional = TH.regional_motion(e, pins).first()
        ru, rv = (regional["speed"] * f(math.radians(regional["bearing"])) for f in (math.sin, math.cos)) if regional else (None, None)
        own = rows.where(F.col("frame_time") == 1800)
        pin = spark.createDataFrame([(1800, 1, *CITY, (ru, rv) if regional else None, True, cell)], "frame_time long, pin_id long, pin_lat double, pin_lon double, background struct<u:double,v:double>, moving boolean, field_km double")
        want = {r["t"]: (r["level"], r["rate"], r["unknown"]) for r in A.timeline(own, pin, anchors).collect()}
        assert anchors.count() >= 1 and {p["t"]: (p["level"], p["rate"], p["unknown"]) for p in found["timeline"]} == want
        lines[cell] = want
    assert len(lines) == 2


def test_hindcast_of_a_cell_that_comes(spark):
    """A cell that marches to the pin and stays: alerts fire and are right, and so is the nowcast."""
    lons = [20.1, 20.25, 20.4, 20.55, 20.7, 20.85, 21.0, 21.0, 21.0, 21.0]
    rows = scene(spark, *[(1_777_766_000 + 600 * i, blob(50.0, x)) for i, x in enumerate(lons)])
    pins = spark.createDataFrame([(1, "Dom", *CITY), (2, "far", 54.0, 15.0)], "pin_id long, label string, lat double, lon double")
    scans = T.rolling_scans(rows).join(V.scored_frames(rows).withColumnRenamed("frame_time", "scan_time"), "scan_time", "left_semi")
    assert scans.count() == 4  # one scan of four frames
    h = V.hindcast(written(TH.threats(TH.echo(rows, scans), pins)), written(V.observed_at_leads(rows, pins)))
    alerts = {(r["config"], r["thr"]): r for r in h.alerts.collect()}
    assert alerts["research", 1]["hit"] == 1 and alerts["shipped", 2]["hit"] == 1 and alerts["shipped", 2]["miss"] == alerts["shipped", 2]["fa"] == 0
    now = {(r["thr"], r["lead"]): r for r in h.nowcast.collect()}
    assert set(now) == {(t, x) for t in (1, 2) for x in (10, 20, 30, 40, 50, 60)} and now[1, 30]["hit"] == 1
    still = {(r["thr"], r["lead"]): r for r in h.persistence.collect()}
    assert all((r["miss"], r["cn"]) == ((1, 0) if lead >= 20 else (0, 1)) for (_, lead), r in still.items())
    mix = h.mix.first()
    assert (mix["n_all"], mix["n_echo"], mix["advected"]) == (2, 1, 100.0)
    buckets = h.calibration.collect()
    assert len(buckets) == 9 and sum(r["n"] for r in buckets) == 1 and max(r["observed"] or 0 for r in buckets) == 1.0
    assert {r["section"] for r in V.long_form(h).collect()} == {"nowcast", "persistence", "alerts", "chance", "motion"}
    assert any("POD 100%" in r["line"] for r in V.report(h).collect())


def test_a_hindcast_needs_its_frames(spark):
    some = lambda *times: scene(spark, *[(t, blob(50.0, 21.0)) for t in times])
    pins = spark.createDataFrame([(1, *CITY)], "pin_id long, lat double, lon double")
    with pytest.raises(ValueError):
        V.scored_frames(some(0, 600, 1200))
    with pytest.raises(ValueError):
        V.scored_frames(some(*range(0, 3600, 600)))
    gap = [600 * i for i in range(10) if i != 5]
    with pytest.raises(Exception, match="no frame 20 minutes after 1800"):
        V.observed_at_leads(some(*gap), pins).collect()


def test_range_join_refuses_what_it_cannot_join(spark):
    rows = spark.createDataFrame([(1, 52.0, 20.0), (2, 71.0, 20.0)], "i long, lat double, lon double")
    right = rows.select(F.col("i").alias("j"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    with pytest.raises(Exception, match="latitude"):
        range_join(rows, right, 10.0).collect()
    assert range_join(rows, right, 10.0, top=75.0).count() == 2


def test_the_hits_of_a_scan_are_not_binned_again(spark):
    """The masses and the motion of a scan are of the same samples."""
    s, read = Scene(spark, SMALL), spark.sparkContext.accumulator(0)
    hits = s.hits

    def counted(*args, **more):
        found = hits(*args, **more)

        def count(parts):
            for part in parts:
                read.add(part.num_rows)
                yield part

        return found.mapInArrow(count, found.schema)

    s.hits = counted
    MQ._trails(s)
    once = read.value
    assert MOQ._echo(s).samples.count() > 0 and once > 0
    assert read.value == once


def test_hits_meet_by_plain_numbers(spark):
    """The hits are grouped by their cells of each factor as they are, not by arrays of them."""
    found = samples(Scene(spark, SMALL), peaked=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    first = [line for line in plan.splitlines() if "Aggregate [" in line][-1]
    assert all(f"{n}{f}#" in first for n in "ij" for f in (1, 2, 4, 8)) and "array" not in first
