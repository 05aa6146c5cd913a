"""The packed form of a frame, and the frames of a scan in either of its shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions import geo

# Fixed values of the format: base64 over records of four 16-bit numbers, low byte first.
LAT0, LON0, RECORD_HEX = 48.0, 11.0, 16
SAMPLES = "array<struct<lat:double,lon:double,level:int,rate:double>>"


def _word(x: Column) -> Column:
    held = F.greatest(F.lit(0), F.least(F.lit(65535), geo.half_up(x))).cast("long")
    digits = F.lpad(F.hex(held), 4, "0")
    return F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2))


def pack(samples: DataFrame) -> DataFrame:
    """``frame_time, packed, n``: each frame as text, samples by class, then place. A frame has at most 9000 samples."""
    record = F.concat(_word((F.col("lat") - LAT0) * 1000), _word((F.col("lon") - LON0) * 1000), _word(F.col("level")), _word(F.coalesce("rate", F.lit(0.0)) * 10))
    rows = samples.select("frame_time", F.struct((-F.col("level")).alias("l"), "lat", "lon", record.alias("record")).alias("s"))
    found = rows.groupBy("frame_time").agg(F.sort_array(F.collect_list("s")).alias("s"))
    text = F.translate(F.base64(F.unhex(F.array_join("s.record", ""))), "\r\n", "")
    return found.select("frame_time", text.alias("packed"), F.size("s").alias("n"))


def unpack(packed: Column) -> Column:
    """The samples of a packed frame; a partial record at the end is ignored, null or empty text has none."""
    digits = F.hex(F.unbase64(F.coalesce(packed, F.lit(""))))
    n = F.floor(F.length(digits) / RECORD_HEX).cast("int")

    def number(at: Column, k: int) -> Column:
        low = F.substring(digits, at * RECORD_HEX + (4 * k + 1), F.lit(2))
        high = F.substring(digits, at * RECORD_HEX + (4 * k + 3), F.lit(2))
        return F.conv(F.concat(high, low), 16, 10).cast("int")

    def sample(at: Column) -> Column:
        return F.struct((LAT0 + number(at, 0) / 1000.0).alias("lat"), (LON0 + number(at, 1) / 1000.0).alias("lon"), F.least(F.lit(4), number(at, 2)).alias("level"), (number(at, 3) / 10.0).alias("rate"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), sample)).otherwise(F.array().cast(SAMPLES))


def frames_of_scans(scans: DataFrame) -> DataFrame:
    """``scan_id, frame_time, samples, cell_km`` of scans that hold either ``history`` or the latest frame and the one before.

    A frame of the history has its samples, or else packed ones, or else none; the cell size falls
    back to the scan's. Without history the previous frame counts only if it has samples.
    """
    read = lambda f: F.when(F.size(f["samples"]) > 0, f["samples"]).otherwise(unpack(f["packed"]))
    of = lambda time, samples, km: F.struct(time.alias("frame_time"), samples.cast(SAMPLES).alias("samples"), km.alias("cell_km"))
    history = F.transform("history", lambda f: of(f["time"], read(f), F.coalesce(f["cell_km"], F.col("cell_km"))))
    before = F.when(F.col("prev_time").isNotNull() & (F.size("prev_samples") > 0), of(F.col("prev_time"), F.col("prev_samples"), F.col("cell_km")))
    latest = F.when(F.col("latest_time").isNotNull(), of(F.col("latest_time"), F.col("samples"), F.col("cell_km")))
    frames = F.when(F.size("history") > 0, history).otherwise(F.array_compact(F.array(before, latest)))
    return scans.select("scan_id", F.explode(frames).alias("f")).select("scan_id", "f.*")


def prefer_source(frames: DataFrame, order: tuple[str, ...] = ("sri", "tile")) -> DataFrame:
    """The frames of each scan from the first source in ``order`` that has any."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    ranked = frames.withColumn("__rank", rank).where("__rank > 0")
    best = ranked.groupBy("scan_id").agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, ["scan_id", "__rank"], "left_semi").drop("__rank")
