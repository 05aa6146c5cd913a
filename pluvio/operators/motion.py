"""Motion of echo by correlation of consecutive frames."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo
from pluvio.functions.const import AGREE_DEG, EARTH_KM, FIELD_CELLS, GRID_HALF_KM, MAX_SHIFT_CELLS, MAX_SHIFT_KM, MAX_SPEED, NCC_CELL_KM, NCC_MIN

HALF = FIELD_CELLS // 2


# As DataFrames.


def cells(samples: DataFrame, lat: float, lon: float, km: float = NCC_CELL_KM) -> DataFrame:
    """``frame_time, ix, iy, v``: the highest class of each cell of the 40 by 40 grid around a point."""
    ix = (geo.half_up((F.col("lon") - lon) / geo.lon_degrees(km, lat)) + HALF).cast("int")
    iy = (geo.half_up((F.col("lat") - lat) / geo.lat_degrees(km)) + HALF).cast("int")
    rows = samples.where("level >= 1").select("frame_time", ix.alias("ix"), iy.alias("iy"), "level")
    return rows.where(f"ix between 0 and {FIELD_CELLS - 1} and iy between 0 and {FIELD_CELLS - 1}").groupBy("frame_time", "ix", "iy").agg(F.max("level").cast("double").alias("v"))


def smooth(grid: DataFrame, r: int = 3) -> DataFrame:
    """Means over the box of ``2 r + 1`` cells, what lies off the grid left out; only cells above zero. Each wet cell is dealt to its box, so that cells of one box meet in a sum."""
    n = FIELD_CELLS
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-r, r + 1) for dy in range(-r, r + 1)])
    spread = grid.withColumn("o", F.explode(offsets)).select("frame_time", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), "v").where(f"ix between 0 and {n - 1} and iy between 0 and {n - 1}")
    side = lambda c: F.least(F.lit(n - 1), F.col(c) + r) - F.greatest(F.lit(0), F.col(c) - r) + 1
    return spread.groupBy("frame_time", "ix", "iy").agg(F.sum("v").alias("v")).withColumn("v", F.col("v") / (side("ix") * side("iy")))


def correlations(grid: DataFrame, times: DataFrame, most: int) -> DataFrame:
    """``prev_time, frame_time, dx, dy, score``: Pearson's r of each frame (cells above zero: ``frame_time, ix, iy, v``) with the one before under every shift of up to ``most`` cells either way, over cells of which one at least is wet, times the part of the grid that overlaps; -1 if fewer than ten cells count or nothing varies.

    A frame is one row with its cells, of which the grid bounds the number; a pair of frames is
    correlated under all shifts at once (``all_scores``).
    """
    frames = grid.groupBy("frame_time").agg(F.collect_list("ix").alias("ix"), F.collect_list("iy").alias("iy"), F.collect_list("v").alias("v"))
    before = frames.select(F.col("frame_time").alias("prev_time"), F.col("ix").alias("px"), F.col("iy").alias("py"), F.col("v").alias("pv"))
    pairs = times.select("prev_time", "frame_time").join(before, "prev_time", "left").join(frames, "frame_time", "left").where("px is not null or ix is not null")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(f"array<{t}>")).alias(c)
    pairs = pairs.select("prev_time", "frame_time", *[empty(c, "int") for c in ("px", "py", "ix", "iy")], empty("pv", "double"), empty("v", "double"))
    dy, dx = (x.ravel() for x in np.mgrid[-most : most + 1, -most : most + 1])

    def drawn(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros((FIELD_CELLS, FIELD_CELLS))
        out[np.asarray(y, dtype=int), np.asarray(x, dtype=int)] = v
        return out

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                scores = all_scores(drawn(row.px, row.py, row.pv), drawn(row.ix, row.iy, row.v), most)
                yield pd.DataFrame({"prev_time": row.prev_time, "frame_time": row.frame_time, "dx": dx, "dy": dy, "score": scores.ravel()})

    return pairs.mapInPandas(run, "prev_time long, frame_time long, dx int, dy int, score double")


# As numpy, for one group of samples: a pair or a short series of frames on one small grid.


def _raster(points: pd.DataFrame, lat: float, lon: float, km: float, half: int) -> np.ndarray:
    out = np.zeros((2 * half, 2 * half))
    x = np.floor((points["lon"].to_numpy() - lon) / (km / (111 * max(math.cos(math.radians(lat)), 0.25))) + 0.5).astype(int) + half
    y = np.floor((points["lat"].to_numpy() - lat) / (km / 111) + 0.5).astype(int) + half
    ok = (x >= 0) & (y >= 0) & (x < 2 * half) & (y < 2 * half)
    np.maximum.at(out, (y[ok], x[ok]), points["level"].to_numpy(dtype=float)[ok])
    return out


def _boxed(grid: np.ndarray, r: int) -> np.ndarray:
    n = len(grid)
    sums = np.zeros((n + 1, n + 1))
    sums[1:, 1:] = grid.cumsum(0).cumsum(1)
    low, high = np.maximum(np.arange(n) - r, 0), np.minimum(np.arange(n) + r + 1, n)
    box = sums[np.ix_(high, high)] - sums[np.ix_(low, high)] - sums[np.ix_(high, low)] + sums[np.ix_(low, low)]
    box[box < 1e-9] = 0.0
    return box / np.outer(high - low, high - low)


def all_scores(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``[dy + most, dx + most]``: the score of ``a`` moved by each shift against ``b``.

    Every sum over the cells that count is a correlation of two of seven fields (values, squares
    and wetness of either grid, and the grid itself), so that it comes for all shifts from one
    product of their transforms. A dry cell adds nothing to the sums of values; the cells that count
    are those wet in either grid less those wet in both.
    """
    n, size = len(a), 1
    while size < n + most + 1:
        size *= 2
    at = np.arange(-most, most + 1)
    spectrum = lambda x: np.fft.rfft2(x, (size, size))
    fields = {"a": a, "aa": a * a, "wa": (a > 0).astype(float), "b": b, "bb": b * b, "wb": (b > 0).astype(float), "one": np.ones_like(a)}
    f = {k: spectrum(x) for k, x in fields.items()}
    sums = lambda p, q: np.fft.irfft2(np.conj(f[p]) * f[q], (size, size))[np.ix_(at % size, at % size)]
    both = np.rint(sums("wa", "wb"))
    count = np.rint(sums("wa", "one")) + np.rint(sums("one", "wb")) - both
    cells = np.maximum(count, 1)
    sa, sb = sums("a", "one"), sums("one", "b")
    va, vb = sums("aa", "one") - sa * sa / cells, sums("one", "bb") - sb * sb / cells
    part = np.outer(n - np.abs(at), n - np.abs(at)) / n**2
    ok = (count >= 10) & (va > 1e-6) & (vb > 1e-6) & (part > 0) & (np.abs(at) < n)[:, None] & (np.abs(at) < n)[None, :]
    r = (sums("a", "b") - sa * sb / cells) / np.sqrt(np.where(ok, va * vb, 1.0))
    return np.where(ok, r * part, -1.0)


def _peak(scores: np.ndarray, most: int) -> tuple[float, int, int] | None:
    """The best shift of ``all_scores``: every second one is looked at first where there are many, then those around the best."""
    step, best = (2 if most > 6 else 1), None
    middle = len(scores) // 2

    def look(shifts: list[tuple[int, int]]) -> None:
        nonlocal best
        for dy, dx in shifts:
            s = scores[middle + dy, middle + dx]
            if s >= NCC_MIN and (best is None or s > best[0] + 1e-9):
                best = (float(s), dx, dy)

    look([(dy, dx) for dy in range(-most, most + 1, step) for dx in range(-most, most + 1, step)])
    if best and step > 1:
        _, cx, cy = best
        look([(cy + j, cx + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i or j) and abs(cx + i) <= most and abs(cy + j) <= most])
    return best


def _distance(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _turn(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    return (math.degrees(math.atan2(math.sin(d - b) * math.cos(c), math.cos(a) * math.sin(c) - math.sin(a) * math.cos(c) * math.cos(d - b))) + 360) % 360


def half_cells(km: float) -> int:
    """Half the side of the grid, in cells."""
    return max(8, int(GRID_HALF_KM / km + 0.5))


def reach_km(km: float) -> float:
    """How far from its centre the grid may reach: half the diagonal, and somewhat more, as it is square in degrees."""
    return 1.5 * half_cells(km) * km


def pair_motion(prev: pd.DataFrame, now: pd.DataFrame, lat: float, lon: float, hours: float, km: float) -> tuple[float, float, float, float] | None:
    """Speed, bearing, distance and score between two frames, or None."""
    if hours <= 0:
        return None
    half = half_cells(km)
    a, b = _raster(prev, lat, lon, km, half), _raster(now, lat, lon, km, half)
    if (a > 0).sum() < 4 or (b > 0).sum() < 4:
        return None
    r = 3 if km >= NCC_CELL_KM else max(1, int(9 / km + 0.5))
    a, b = _boxed(a, r), _boxed(b, r)
    most = max(1, min(MAX_SHIFT_CELLS, 2 * half // 3, math.ceil(min(MAX_SPEED * hours, MAX_SHIFT_KM) / km)))
    scores = all_scores(a, b, most + 1)  # a shift more on each side, for the parabola
    peak = _peak(scores, most)
    if peak is None:
        return None
    score, dx, dy = peak
    if not dx and not dy:
        return 0.0, 0.0, 0.0, score

    def between(low: float, high: float) -> float:
        """Where the parabola through the peak and its neighbours is highest."""
        bend = low - 2 * score + high
        return 0.0 if min(low, high) < NCC_MIN or bend >= 0 else max(-0.5, min(0.5, 0.5 * (low - high) / bend))

    of = lambda x, y: float(scores[most + 1 + y, most + 1 + x])
    x = dx + between(of(dx - 1, dy), of(dx + 1, dy))
    y = dy + between(of(dx, dy - 1), of(dx, dy + 1))
    to = lat + y * km / 111, lon + x * km / (111 * max(math.cos(math.radians(lat)), 0.25))
    moved = _distance(lat, lon, *to)
    return None if moved / hours > MAX_SPEED else (moved / hours, _turn(lat, lon, *to), moved, score)


def _mean_turn(parts: list[tuple[float, float, float, float]]) -> float:
    x, y = (sum(p[1] * f(math.radians(p[0])) for p in parts) for f in (math.cos, math.sin))
    return (math.degrees(math.atan2(y, x)) + 360) % 360


def system_motion(frames: list[tuple[int, pd.DataFrame]], lat: float, lon: float, km: float) -> tuple[float, float, int] | None:
    """Speed, bearing and confidence of a series of frames: consecutive pairs, and the ends with more weight; pairs that turn 40 degrees off the mean do not count."""
    pairs = [(a, b, 1.0) for a, b in zip(frames[:-1], frames[1:], strict=True)]
    if len(frames) > 1 and frames[-1][0] > frames[0][0]:
        pairs.append((frames[0], frames[-1], 2.5))
    parts = []
    for (t0, prev), (t1, now), more in pairs:
        found = pair_motion(prev, now, lat, lon, (t1 - t0) / 3600, km)
        if found and found[0] >= 1:
            speed, turn, moved, score = found
            parts.append((turn, max(moved, 1.0) * more * max(score, NCC_MIN), speed, score))
    if not parts:
        return None
    mean = _mean_turn(parts)
    off = lambda p: min((d := abs(p[0] - mean) % 360), 360 - d)
    use = [p for p in parts if off(p) <= AGREE_DEG] or parts
    weight = sum(p[1] for p in use)
    speed, best = sum(p[2] * p[1] for p in use) / weight, max(p[3] for p in use)
    agreed = len([p for p in parts if off(p) <= AGREE_DEG])
    if not 1 <= speed <= MAX_SPEED:
        return None
    return speed, _mean_turn(use), int(min(95.0, 40 + 40 * best + 8 * min(len(use), 3) + 5 * (agreed == len(parts))) + 0.5)


def _of_group(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frames = [(int(t), g) for t, g in rows.groupby("frame_time", sort=True)]
        first = rows.iloc[0]
        found = system_motion(frames, float(first["c_lat"]), float(first["c_lon"]), float(first["km"]))
        return pd.DataFrame([(*(first[k] for k in keys), *found)] if found else [], columns=[*keys, "speed", "bearing", "confidence"])

    return run


def motions(samples: DataFrame, keys: list[str], km: Column | float = NCC_CELL_KM) -> DataFrame:
    """``keys, speed, bearing, confidence`` of each group of ``samples`` (keys, frame_time, lat, lon, level, c_lat, c_lon: the centre), on cells of ``km``, one size for a group.

    A group is a few frames of at most some thousand samples each, as the grid bounds them.
    """
    kinds = dict(samples.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    rows = samples.withColumn("km", km if isinstance(km, Column) else F.lit(float(km)))
    return rows.groupBy(*keys).applyInPandas(_of_group(keys), f"{schema}, speed double, bearing double, confidence int")
