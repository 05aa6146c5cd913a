"""Covers of polygons, tiles, correlation under all shifts, trails and fields, and functions in SQL, against plain loops."""

from __future__ import annotations

import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from compare import duck
from conftest import DATA
from pyspark.sql import functions as F

from pluvio.functions import sql
from pluvio.operators import cover, motion
from pluvio.operators import threat as TH
from pluvio.operators import trails as T
from pluvio.operators import warnings as W
from pluvio.plans import stream_queries as SQ
from pluvio.sources import tiles

# Polygons


def outline(rng, x, y, size, n=40):
    """A star of uneven rays."""
    turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * rng.uniform(0.4, 1) * math.cos(a), y + size * rng.uniform(0.4, 1) * math.sin(a)) for a in turn]


def edges_of(spark, polygons):
    """``polygons``: (code, part, rings)."""
    rows = []
    for code, part, rings in polygons:
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        for k, ring in enumerate(rings):
            rows += [(code, part, k, *a, *b, min(xs), min(ys), max(xs), max(ys)) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return spark.createDataFrame(rows, "code string, part int, ring int, x1 double, y1 double, x2 double, y2 double, min_x double, min_y double, max_x double, max_y double")


def holds(rings, x, y):
    """The rule, edge by edge."""
    odd = []
    for ring in rings:
        n = 0
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                n += 1
        odd.append(n % 2 == 1)
    return odd[0] and not any(odd[1:])


def test_counties_equal_ray_casting(spark):
    rng = random.Random(8)
    polygons = []
    for k in range(12):
        x, y = 15 + rng.random() * 6, 50 + rng.random() * 4
        rings = [outline(rng, x, y, rng.uniform(0.1, 1.5))] + ([outline(rng, x, y, 0.08, 9), outline(rng, x + 0.05, y, 0.03, 5)] if k % 2 else [])
        polygons.append((f"{k // 2:04d}", k % 2, rings))  # two polygons a county
    polygons.append(("9999", 0, [[(16.0, 51.0), (17.0, 51.0), (17.0, 52.0), (16.0, 52.0)]]))  # on the cells' own lines
    points = [(i, rng.uniform(49, 55), rng.uniform(14, 22)) for i in range(1500)] + [(2000 + i, 51 + a / 4, 16 + b / 4) for i, (a, b) in enumerate((a, b) for a in range(5) for b in range(5))] + [(3000 + i, p[1], p[0]) for i, p in enumerate(polygons[0][2][0])]
    area = {c: min((max(p[0] for r in rs for p in r) - min(p[0] for r in rs for p in r)) * (max(p[1] for r in rs for p in r) - min(p[1] for r in rs for p in r)) for cc, _, rs in polygons if cc == c) for c, _, _ in polygons}
    assert area
    want = {}
    for i, lat, lon in points:
        own = []
        for code, _, rings in polygons:
            if holds(rings, lon, lat):
                xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
                own.append(((max(xs) - min(xs)) * (max(ys) - min(ys)), code))
        if own:
            want[i] = min(own)[1]
    edges = edges_of(spark, polygons)
    table = spark.createDataFrame(points, "pin_id long, lat double, lon double")
    for deepest in (0, 3, 6):
        assert {r["pin_id"]: r["code"] for r in cover.counties_of(table, edges, deepest).collect()} == want
    assert len(want) > 200 and W.in_polygon(table, edges).count() == len(want)


def test_points_of_inside_cells_meet_no_edge(spark):
    square = edges_of(spark, [("0001", 0, [[(15.3, 50.2), (18.9, 50.2), (18.9, 53.7), (15.3, 53.7)]])])
    points = spark.range(4000).select(F.col("id").alias("pin_id"), (50 + F.rand(1) * 4).alias("lat"), (15 + F.rand(2) * 4).alias("lon"))
    met = cover.in_cells(points, cover.cover(square)).select("pin_id", "inside", F.size("edges").alias("n"))
    kept = met.groupBy("inside").agg(F.count("*").alias("points"), F.sum(F.coalesce("n", F.lit(0))).alias("edges"), F.max("n").alias("most")).collect()
    by = {r["inside"]: r for r in kept}
    # Inside cells carry no edge at all, and most points lie in one; the others meet at most the four edges of the square.
    assert by[True]["most"] is None and by[True]["points"] > 5 * by[False]["points"] and by[False]["edges"] <= 4 * by[False]["points"]
    assert met.count() == met.select("pin_id").distinct().count()


# Tiles


def png(kind, rows, channels, extra=b"", filters=5):
    """``rows``: bytes [row, column, channel]; every row by another filter."""
    height, width, _ = rows.shape
    out, above = b"", np.zeros((width, channels), dtype=int)
    for k in range(height):
        own, how = rows[k].astype(int), k % filters
        left = np.vstack((np.zeros((1, channels), dtype=int), own[:-1]))
        corner = np.vstack((np.zeros((1, channels), dtype=int), above[:-1]))
        guess = left + above - corner
        best = np.where((abs(guess - left) <= abs(guess - above)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - above) <= abs(guess - corner), above, corner))
        out += bytes([how]) + ((own - [0, left, above, (left + above) // 2, best][how]) % 256).astype(np.uint8).tobytes()
        above = own
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = zlib.compress(out)
    return tiles.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", body[:40]) + chunk(b"IDAT", body[40:]) + chunk(b"IEND", b"")


def test_tiles_of_every_kind_round_trip():
    rng = np.random.default_rng(1)
    for kind, channels in tiles.CHANNELS.items():
        rows = rng.integers(0, 4 if kind == 3 else 256, (23, 17, channels)).astype(np.uint8)
        shades = rng.integers(0, 256, (4, 3)).astype(np.uint8)
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        extra = chunk(b"PLTE", shades.tobytes()) + chunk(b"tRNS", bytes([0, 7])) if kind == 3 else b""
        got = tiles.decoded(png(kind, rows, channels, extra))
        if kind == 3:
            assert (got[..., :3] == shades[rows[..., 0]]).all() and (got[..., 3] == np.array([0, 7, 255, 255])[rows[..., 0]]).all()
        else:
            assert (got[..., :3] == (rows[..., :3] if channels >= 3 else rows[..., :1])).all()
            assert (got[..., 3] == (rows[..., -1] if channels in (2, 4) else 255)).all()


def test_files_that_are_no_tiles():
    whole = png(6, np.zeros((4, 4, 4), dtype=np.uint8), 4)
    for broken in (b"", b"<html>", whole[:40], whole[:60] + b"x" + whole[61:], whole.replace(b"\x08\x06", b"\x10\x06")):
        with pytest.raises(tiles.NotATile):
            tiles.decoded(broken)


def test_a_frame_with_a_missing_or_damaged_tile_is_not_complete(spark, tmp_path):
    rows = [(f, x, y, 2 * k, 2 * x % 256, 0xFF, 0xEE, 0, 255) for f in (600, 1200, 1800) for x in (35, 36) for y in (20, 21) for k in range(3) if (f, x, y) != (1200, 36, 21)]
    SQ.write_tiles(spark.createDataFrame(rows, "frame_time long, x long, y long, px long, py long, r int, g int, b int, a int"), str(tmp_path))
    (tmp_path / "1800" / "35" / "20.png").write_bytes(b"<html>no</html>")
    hits, whole = tiles.scan_tiles(spark, str(tmp_path), spark.createDataFrame([(x, y) for x in (35, 36) for y in (20, 21)], "x long, y long"))
    assert {r["frame_time"]: r["complete"] for r in whole.collect()} == {600: True, 1200: False, 1800: False}
    assert {r["frame_time"]: r["count"] for r in hits.groupBy("frame_time").count().collect()} == {600: 12, 1200: 9, 1800: 9}


# Correlation


def plain_score(a, b, dx, dy):
    """Pearson's r over the overlap's wet cells, as it is defined."""
    n = len(a)
    if abs(dx) >= n or abs(dy) >= n:
        return -1.0
    p = a[max(0, -dy) : n - max(0, dy), max(0, -dx) : n - max(0, dx)]
    q = b[max(0, dy) : n - max(0, -dy), max(0, dx) : n - max(0, -dx)]
    wet = (p > 0) | (q > 0)
    if wet.sum() < 10 or np.var(p[wet]) * wet.sum() <= 1e-6 or np.var(q[wet]) * wet.sum() <= 1e-6:
        return -1.0
    return float(np.corrcoef(p[wet], q[wet])[0, 1]) * (n - abs(dx)) * (n - abs(dy)) / n**2


def test_all_shifts_at_once_equal_each_by_itself():
    rng = np.random.default_rng(3)
    for n, most, wet in ((40, 10, 0.2), (16, 20, 0.5), (9, 3, 0.05), (30, 24, 0.0), (20, 5, 1.0)):
        a, b = (rng.random((n, n)) * 4 * (rng.random((n, n)) < wet) for _ in range(2))
        got = motion.all_scores(a, b, most)
        want = np.array([[plain_score(a, b, dx, dy) for dx in range(-most, most + 1)] for dy in range(-most, most + 1)])
        assert np.abs(got - want).max() < 1e-9
    flat = np.ones((12, 12))
    assert (motion.all_scores(flat, flat, 4) == -1).all()


@pytest.mark.parametrize("cell", [3.0, 6.0, 12.0, 24.0])
def test_regional_motion_sees_all_that_the_grid_holds(spark, cell):
    """The motion around a pin equals the kernel's on every sample, whatever the size of cells."""
    rng = np.random.default_rng(int(cell))
    lat, lon = 52.0, 20.0
    shape = [(lat + rng.normal() * cell / 30, lon + rng.normal() * cell / 20, int(rng.integers(1, 5))) for _ in range(500)]
    rows = [(600 * k, a, b + k * cell / 60, lv, None, cell) for k in range(3) for a, b, lv in shape]
    table = spark.createDataFrame(rows, "frame_time long, lat double, lon double, level int, rate double, cell_km double")
    pins = spark.createDataFrame([(1, lat, lon)], "pin_id long, lat double, lon double")
    empty = spark.createDataFrame([], "x int")
    scans = T.one_scan(table)
    e = TH.Echo(table, scans, T.ends_of(scans, table), empty, empty, empty, empty)
    got = TH.regional_motion(e, pins).collect()
    centre = TH.P.correlation_centre(table.where("frame_time = 1200"), pins).first()
    frames = [(600 * k, pd.DataFrame([(a, b + k * cell / 60, lv) for a, b, lv in shape], columns=["lat", "lon", "level"])) for k in range(3)]
    want = motion.system_motion(frames, centre["lat"], centre["lon"], cell)
    assert want is not None and len(got) == 1
    assert (got[0]["speed"], got[0]["bearing"], got[0]["confidence"]) == pytest.approx(want)


# Trails


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 33])
def test_trails_go_back_as_far_as_the_scan(spark, n):
    """Masses in a chain of ``n`` frames, with a branch, a jump that is too fast, and a scan of the last three alone."""
    found = spark.createDataFrame([(300 * k, m, 52.0 + m, 20.0, 5, 2, 1.5) for k in range(n) for m in (1, 2, 3)], "frame_time long, mass_id long, lat double, lon double, n long, max_level int, mean_level double")
    links = [(300 * k, m, 300 * (k - 1), 1 if m == 2 else m, 9.0 if (m, k) == (3, 4) else 1.0, 300, 0.0) for k in range(1, n) for m in (1, 2, 3)]
    matched = spark.createDataFrame(links, "frame_time long, mass_id long, prev_time long, prev_id long, d double, dt long, score double")
    whole = [(300 * (n - 1), 300 * k) for k in range(n)]
    scans = spark.createDataFrame(whole + [(-1, 300 * k) for k in range(max(0, n - 3), n)], "scan_time long, frame_time long")
    got = sorted((r["scan_time"], r["trail_id"], r["frame_time"], r["mass_id"]) for r in T.trails(found, matched, scans).collect())
    want = []
    for scan, first in ((300 * (n - 1), 0), (-1, max(0, n - 3))):
        for m in (1, 2, 3):
            at = m
            for k in range(n - 1, first - 1, -1):
                want.append((scan, m, 300 * k, at))
                if (at, k) == (3, 4):
                    break
                at = 1 if at == 2 else at
    assert got == sorted(want)


# SQL


def test_functions_resolve_in_plain_sql(spark):
    sql.register(spark)
    sql.register(spark)  # again, as another query may
    row = spark.sql("select haversine_km(52, 21, 52, 21) as zero, rain_level(0.1) as drizzle, rain_level(null) as none, rain_level_name(4) as name, coming_from(0) as north, going_toward(359.9) as up, half_up(2.5, 0) as three, angle_between(350, 10) as d, rate_of_dbz(23.0103) as one").first()
    assert (row["zero"], row["drizzle"], row["none"], row["name"], row["north"], row["up"], row["three"], row["d"]) == (0.0, 1, 0, "ulewny", "południa", "północ", 3.0, 20.0)
    assert row["one"] == pytest.approx(1.0, abs=1e-4)
    assert spark.sql("select count(*) as n, max(dbz) as most from radar_palette()").first()["n"] == 52
    odd = spark.createDataFrame([(1, 255, 238, 0, 255), (2, 255, 238, 0, 10), (3, 10, 200, 90, 255), (4, 250, 240, 3, 255)], "id long, r int, g int, b int, a int")
    got = {r["id"]: r["dbz"] for r in spark.sql("select * from pixel_dbz(table(select * from {odd}))", odd=odd).collect()}
    assert got == {1: 35, 2: None, 3: None, 4: 35}


def test_sql_rows_equal_the_column_functions(spark):
    from pluvio.plans import catalog

    own = {r["event_id"]: (r["km"], r["level"]) for r in catalog.queries()["sql_geometry"](spark, f"{DATA}/sf0.001").collect()}
    km = {r["event_id"]: r["km"] for r in catalog.queries()["geo_haversine"](spark, f"{DATA}/sf0.001").collect()}
    level = {r["event_id"]: r["level"] for r in catalog.queries()["classify_rate"](spark, f"{DATA}/sf0.001").collect()}
    assert own == {k: (km[k], level[k]) for k in km} and duck is not None
