"""Delivery of alerts: each event once, whole batches or none of them."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.sources.polling import _store

#: Where an event shows: on the page, and beyond it as a notice.
BANNER, NOTICE = "banner", "notice"


def in_quiet_hours(hour: Column, since: Column | int, until: Column | int) -> Column:
    """Whether an hour (with fractions) lies in the quiet ones, which may pass midnight; equal bounds turn them off."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (since, until))
    return F.when(a == b, False).when(a < b, (hour >= a) & (hour < b)).otherwise((hour >= a) | (hour < b))


def committed(path: str) -> list[tuple[int, str]]:
    """The batches that were delivered whole, by number: those whose folder has the mark that Spark sets when all of a write has come through."""
    store, root = _store(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.Directory and info.base_name.startswith("batch=") and store.get_file_info(f"{info.path}/_SUCCESS").type == fs.FileType.File:
            found.append((int(info.base_name.removeprefix("batch=")), f"{path}/{info.base_name}"))
    return sorted(found)


KEPT = "pin_id long, event_id string, at timestamp, kind string, title string, body string, day date, channel string"


def delivered(spark: SparkSession, path: str, besides: int | None = None) -> DataFrame:
    """``pin_id, event_id, at, kind, title, body, day, channel`` of all that was delivered; without the batch ``besides``."""
    paths = [p for n, p in committed(path) if n != besides]
    if not paths:
        return spark.createDataFrame([], KEPT)
    names = [c.split()[0] for c in KEPT.split(", ")]
    return spark.read.schema(KEPT).option("basePath", path).parquet(*paths).select(*names)


def sink(path: str, since: Column | int = 0, until: Column | int = 0, zone: str = "Europe/Warsaw") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: events (``pin_id, event_id, at, kind, title, body``) go to the banner, and outside the quiet hours to the notices too.

    An event is known by its pin and ``event_id``. One that was delivered on the same day by another
    batch is left out, so that a source that says things twice tells them once. Both channels of a
    batch are one write into the batch's own folder, which replaces what an attempt that failed has
    left there, and which counts only once it is complete; a batch delivered again gives the same folder.
    """

    def deliver(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        one = events.select(F.col("pin_id").cast("long").alias("pin_id"), "event_id", F.col("at").cast("timestamp").alias("at"), "kind", "title", "body").dropDuplicates(["pin_id", "event_id"]).withColumn("day", F.to_date("at"))
        before = delivered(spark, path, batch_id).where(F.col("channel") == BANNER).select("pin_id", "event_id", "day")
        new = one.join(before, ["pin_id", "event_id", "day"], "left_anti")
        local = F.from_utc_timestamp(F.to_utc_timestamp("at", F.current_timezone()), zone)
        quiet = in_quiet_hours(F.hour(local) + F.minute(local) / 60.0, since, until)
        channels = F.when(quiet, F.array(F.lit(BANNER))).otherwise(F.array(F.lit(BANNER), F.lit(NOTICE)))
        rows = new.withColumn("channel", F.explode(channels))
        rows.write.mode("overwrite").partitionBy("day", "channel").parquet(f"{path}/batch={batch_id}")

    return deliver
