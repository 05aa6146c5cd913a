"""Functions for those who write SQL: geometry and classes as SQL functions, the palette and classes of pixels as table functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from pluvio.functions.const import CLASS_RATES, EARTH_KM, FROM_PL, NEAREST_COLOUR, PALETTE, TOWARD_PL

_A, _B, _C, _D = (f"radians({x})" for x in ("lat1", "lon1", "lat2", "lon2"))
_H = f"(power(sin(({_C} - {_A}) / 2), 2) + cos({_A}) * cos({_C}) * power(sin(({_D} - {_B}) / 2), 2))"
_UP = f"asin(sin(radians(lat)) * cos(km / {EARTH_KM}D) + cos(radians(lat)) * sin(km / {EARTH_KM}D) * cos(radians(bearing)))"
_PLACES = "lat1 double, lon1 double, lat2 double, lon2 double"


def _names(names: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def _eighth(degrees: str) -> str:
    return f"cast(pmod(floor(pmod({degrees}, 360D) / 45D + 0.5D), 8) as int) + 1"


#: Name, parameters, type and body of each function. Catalyst puts the body in the function's place, so that a call is planned as the expression would be.
FUNCTIONS = {
    "haversine_km": (_PLACES, "double", f"{2 * EARTH_KM}D * atan2(sqrt({_H}), sqrt(1 - {_H}))"),
    "bearing_deg": (_PLACES, "double", f"pmod(degrees(atan2(sin({_D} - {_B}) * cos({_C}), cos({_A}) * sin({_C}) - sin({_A}) * cos({_C}) * cos({_D} - {_B}))) + 360D, 360D)"),
    "destination": ("lat double, lon double, bearing double, km double", "struct<lat: double, lon: double>", f"named_struct('lat', degrees({_UP}), 'lon', degrees(radians(lon) + atan2(sin(radians(bearing)) * sin(km / {EARTH_KM}D) * cos(radians(lat)), cos(km / {EARTH_KM}D) - sin(radians(lat)) * sin({_UP}))))"),
    "angle_between": ("a double, b double", "double", "least(pmod(abs(a - b), 360D), 360D - pmod(abs(a - b), 360D))"),
    "coming_from": ("bearing double", "string", f"element_at({_names(FROM_PL)}, {_eighth('bearing + 180D')})"),
    "going_toward": ("bearing double", "string", f"element_at({_names(TOWARD_PL)}, {_eighth('bearing')})"),
    "rate_of_dbz": ("dbz double", "double", "power(power(10D, dbz / 10D) / 200D, 1 / 1.6D)"),
    "rain_level": ("rate double", "int", "case " + " ".join(f"when rate >= {r}D then {k}" for k, r in reversed(list(enumerate(CLASS_RATES, 1)))) + " else 0 end"),
    "rain_level_name": ("level int", "string", "element_at(array('brak', 'słaby', 'umiarkowany', 'silny', 'ulewny'), level + 1)"),
    "half_up": ("x double, digits int", "double", "floor(x * power(10D, digits) + 0.5D) / power(10D, digits)"),
}


@arrow_udtf(returnType="dbz int, r int, g int, b int")
class RadarPalette:
    """``radar_palette()``: the colours of the radar and their dBZ."""

    def eval(self):  # noqa: ANN201  Spark reads the type above
        rgb = np.array([c for _, c in PALETTE])
        yield pa.table({"dbz": pa.array([d for d, _ in PALETTE], pa.int32()), **{n: pa.array((rgb >> s & 255).astype(np.int32)) for n, s in (("r", 16), ("g", 8), ("b", 0))}})


@arrow_udtf(returnType="id long, dbz int")
class PixelDbz:
    """``pixel_dbz(table(...))``: dBZ of pixels (``id, r, g, b, a``), batch by batch: of the palette's nearest colour under 28 away, the first of equals; null where a pixel is clear or of no such colour."""

    def eval(self, pixels: pa.RecordBatch):  # noqa: ANN201
        rgba = np.stack([pixels.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("r", "g", "b", "a")], axis=1)
        shades = np.array([[c >> 16, c >> 8 & 255, c & 255] for _, c in PALETTE])
        away = ((rgba[:, None, :3] - shades[None, :, :]) ** 2).sum(axis=2)
        best = away.argmin(axis=1)
        known = (rgba[:, 3] >= 200) & (away[np.arange(len(best)), best] < NEAREST_COLOUR**2)
        dbz = np.array([d for d, _ in PALETTE], dtype=np.int32)[best]
        yield pa.table({"id": pixels.column("id").cast(pa.int64()), "dbz": pa.array(dbz, mask=~known)})


def register(spark: SparkSession) -> None:
    """Makes all of them known to a session: ``FUNCTIONS``, ``radar_palette`` and ``pixel_dbz``."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    spark.udtf.register("radar_palette", RadarPalette)
    spark.udtf.register("pixel_dbz", PixelDbz)
