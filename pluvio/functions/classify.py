"""Rain rates, classes and radar colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.const import CLASS_RATES, NEAREST_COLOUR, PALETTE


def rate_of_dbz(dbz: Column) -> Column:
    """Rain rate in mm/h of a reflectivity, by Marshall and Palmer."""
    return F.pow(F.pow(F.lit(10.0), dbz / 10.0) / 200.0, F.lit(1 / 1.6))


def level_of_rate(rate: Column) -> Column:
    """Class 0 to 4."""
    out = F.lit(0)
    for level, least in enumerate(CLASS_RATES, 1):
        out = F.when(rate >= least, level).otherwise(out)
    return out


def rate_of_sample(rate: Column, level: Column) -> Column:
    """The rate, or where there is none the least of the class."""
    floors = F.array(F.lit(0.0), *map(F.lit, CLASS_RATES))
    return F.coalesce(rate, F.element_at(floors, F.greatest(F.lit(0), F.least(F.lit(4), level)).cast("int") + 1))


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("brak", "słaby", "umiarkowany", "silny", "ulewny"))), level.cast("int") + 1)


def palette(df: DataFrame) -> DataFrame:
    """The 52 palette rows."""
    return df.sparkSession.createDataFrame(PALETTE, "dbz int, rgb int")


def colours_to_dbz(pixels: DataFrame) -> DataFrame:
    """``pixels`` (r, g, b, a) with ``dbz``: that of the palette's colour, or of the nearest one under 28 away; null if translucent or foreign.

    Each distinct colour is looked up once, against an array of 52 literals, so that no join is needed.
    """
    key = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    shades = F.array(*[F.struct(F.lit(d).alias("dbz"), F.lit(c >> 16).alias("r"), F.lit(c >> 8 & 255).alias("g"), F.lit(c & 255).alias("b")) for d, c in PALETTE])
    exact = F.create_map(*[F.lit(x) for d, c in PALETTE for x in (c, d)])
    away = lambda s: F.pow(F.col("r") - s["r"], 2) + F.pow(F.col("g") - s["g"], 2) + F.pow(F.col("b") - s["b"], 2)
    best = F.array_min(F.transform(shades, lambda s, i: F.struct(away(s).alias("d"), i.alias("i"), s["dbz"].alias("dbz"))))
    near = F.when(best["d"] < NEAREST_COLOUR**2, best["dbz"])
    return pixels.withColumn("dbz", F.when(F.col("a") >= 200, F.coalesce(exact[key], near)))
