"""Geometry on the sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvio.functions.const import AEQD_LAT, AEQD_LON, EARTH_KM, EARTH_M, LR_LAT, LR_LON, RASTER, UL_LAT, UL_LON

Value = Column | float | int


def col(x: Value | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded, halves toward plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def haversine(lat1: Value | str, lon1: Value | str, lat2: Value | str, lon2: Value | str) -> Column:
    """Great-circle distance in km."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def destination(lat: Value | str, lon: Value | str, bearing: Value | str, km: Value | str) -> tuple[Column, Column]:
    """Latitude and longitude after ``km`` along the bearing."""
    a, b, turn, d = F.radians(col(lat)), F.radians(col(lon)), F.radians(col(bearing)), col(km) / EARTH_KM
    up = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(turn))
    return F.degrees(up), F.degrees(b + F.atan2(F.sin(turn) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(up)))


def bearing(lat1: Value | str, lon1: Value | str, lat2: Value | str, lon2: Value | str) -> Column:
    """Initial bearing in degrees, clockwise from north."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    y, x = F.sin(d - b) * F.cos(c), F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def compass(degrees: Column, names: tuple[str, ...]) -> Column:
    """One of eight names."""
    at = F.pmod(half_up(F.pmod(degrees, F.lit(360.0)) / 45.0), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, names)), at + 1)


def angle_between(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def to_uv(degrees: Column, speed: Column) -> tuple[Column, Column]:
    """East and north parts of a motion."""
    return speed * F.sin(F.radians(degrees)), speed * F.cos(F.radians(degrees))


def from_uv(u: Column, v: Column) -> tuple[Column, Column]:
    """Bearing and speed of a motion."""
    return F.pmod(F.degrees(F.atan2(u, v)) + 360.0, F.lit(360.0)), F.sqrt(u * u + v * v)


def tile(lon: Value | str, lat: Value | str, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile coordinates with fractions."""
    n = float(2**zoom)
    up = F.radians(col(lat))
    return (col(lon) + 180.0) / 360.0 * n, (1.0 - F.log(F.tan(up) + 1.0 / F.cos(up)) / F.pi()) / 2.0 * n


def tile_pixel(zoom: int, x: Column, y: Column, px: Column, py: Column, size: float = 256.0) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel of a tile."""
    n = float(2**zoom)
    mercator = F.pi() * (1.0 - 2.0 * (y + py / size) / n)
    return F.degrees(F.atan(F.sinh(mercator))), (x + px / size) / n * 360.0 - 180.0


def project(lat: Value | str, lon: Value | str) -> tuple[Column, Column]:
    """Azimuthal equidistant metres around the composite's origin."""
    a0, b0, a, b = F.radians(F.lit(AEQD_LAT)), F.radians(F.lit(AEQD_LON)), F.radians(col(lat)), F.radians(col(lon))
    turn = b - b0
    c = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(a0) * F.sin(a) + F.cos(a0) * F.cos(a) * F.cos(turn))))
    k = F.when(c < 1e-12, 1.0).otherwise(c / F.sin(c))
    return EARTH_M * k * F.cos(a) * F.sin(turn), EARTH_M * k * (F.cos(a0) * F.sin(a) - F.sin(a0) * F.cos(a) * F.cos(turn))


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of azimuthal equidistant metres."""
    a0 = F.radians(F.lit(AEQD_LAT))
    r = F.sqrt(x * x + y * y)
    c = r / EARTH_M
    lat = F.degrees(F.asin(F.cos(c) * F.sin(a0) + y * F.sin(c) * F.cos(a0) / r))
    lon = F.lit(AEQD_LON) + F.degrees(F.atan2(x * F.sin(c), r * F.cos(a0) * F.cos(c) - y * F.sin(a0) * F.sin(c)))
    return F.when(r < 1e-9, AEQD_LAT).otherwise(lat), F.when(r < 1e-9, AEQD_LON).otherwise(lon)


def georeference(n: Value = RASTER) -> tuple[Column, Column, Column, Column]:
    """Pixel width, pixel height, and the upper left corner of a raster of n by n pixels between the composite's corners, in metres."""
    left, top = project(UL_LAT, UL_LON)
    right, bottom = project(LR_LAT, LR_LON)
    return (right - left) / col(n), (top - bottom) / col(n), left, top


def pixel_centre(column: Column, row: Column, n: int = RASTER) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel's centre; row 0 is north."""
    width, height, left, top = georeference(n)
    return unproject(left + (column + 0.5) * width, top - (row + 0.5) * height)


def covered(lat: Value | str, lon: Value | str, n: int = RASTER) -> Column:
    """Whether the composite's raster covers a point."""
    width, height, left, top = georeference(n)
    x, y = project(lat, lon)
    c, r = (x - left) / width, (top - y) / height
    return (c >= 0) & (c < n) & (r >= 0) & (r < n)


def lat_degrees(km: Value) -> Column:
    return col(km) / 111.0


def lon_degrees(km: Value, lat: Value | str) -> Column:
    return col(km) / (111.0 * F.greatest(F.cos(F.radians(col(lat))), F.lit(0.25)))
