"""Pieces of DuckDB SQL that the queries' SQL shares."""

from __future__ import annotations

from pluvio.functions.const import AEQD_LAT, AEQD_LON, EARTH_M, LR_LAT, LR_LON, RASTER, UL_LAT, UL_LON


def num(x: float) -> str:
    return f"cast({x!r} as double)"


def half_up(x: str, digits: int = 0) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}" if digits else f"floor(({x}) + 0.5)"


def km(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(12742e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def dest(lat: str, lon: str, turn: str, d: str) -> tuple[str, str]:
    up = f"asin(sin(radians({lat})) * cos(({d}) / 6371e0) + cos(radians({lat})) * sin(({d}) / 6371e0) * cos(radians({turn})))"
    right = f"degrees(radians({lon}) + atan2(sin(radians({turn})) * sin(({d}) / 6371e0) * cos(radians({lat})), cos(({d}) / 6371e0) - sin(radians({lat})) * sin({up})))"
    return f"degrees({up})", right


def turn(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d}) - radians({b})) * cos(radians({c}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))"
    return f"((degrees(atan2({y}, {x})) + 360e0) % 360e0)"


def project(lat: str, lon: str) -> tuple[str, str]:
    a0, dl, a = f"radians({num(AEQD_LAT)})", f"(radians({lon}) - radians({num(AEQD_LON)}))", f"radians({lat})"
    c = f"acos(least(1e0, greatest(-1e0, sin({a0}) * sin({a}) + cos({a0}) * cos({a}) * cos({dl}))))"
    k = f"(case when {c} < 1e-12 then 1e0 else {c} / sin({c}) end)"
    return f"({EARTH_M!r} * {k} * cos({a}) * sin({dl}))", f"({EARTH_M!r} * {k} * (cos({a0}) * sin({a}) - sin({a0}) * cos({a}) * cos({dl})))"


def unproject(x: str, y: str) -> tuple[str, str]:
    a0, r = f"radians({num(AEQD_LAT)})", f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    c = f"({r} / {EARTH_M!r})"
    lat = f"degrees(asin(cos({c}) * sin({a0}) + ({y}) * sin({c}) * cos({a0}) / {r}))"
    lon = f"({num(AEQD_LON)} + degrees(atan2(({x}) * sin({c}), {r} * cos({a0}) * cos({c}) - ({y}) * sin({a0}) * sin({c}))))"
    return f"(case when {r} < 1e-9 then {num(AEQD_LAT)} else {lat} end)", f"(case when {r} < 1e-9 then {num(AEQD_LON)} else {lon} end)"


def georef(n: int = RASTER) -> str:
    """Columns gw, gh, gl, gt of a one-row select."""
    left, top = project(num(UL_LAT), num(UL_LON))
    right, bottom = project(num(LR_LAT), num(LR_LON))
    return f"select ({right} - {left}) / {n} as gw, ({top} - {bottom}) / {n} as gh, {left} as gl, {top} as gt"


def level(rate: str) -> str:
    return f"(case when {rate} >= 10 then 4 when {rate} >= 4 then 3 when {rate} >= 1 then 2 when {rate} >= 0.1e0 then 1 else 0 end)"


def pick(names: tuple[str, ...], at: str) -> str:
    return "(case " + " ".join(f"when {at} = {i} then '{x}'" for i, x in enumerate(names)) + " end)"
