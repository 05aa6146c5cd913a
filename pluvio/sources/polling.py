"""Frames that arrive one by one: a folder that is looked at again and again, as a data source of its own."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Seconds between two looks, and frames that one look takes.
POLL_SECONDS, NEWEST = 90, 4
SAMPLES = "frame_time long, lat double, lon double, level int, rate double, cell_km double"
#: The time of a frame in the name of its file or folder.
STAMP = r"(?:frame_time=|^|/)(\d{9,14})"
FORMAT = "frame_listing"


@dataclass(frozen=True)
class Entry:
    """A file of a frame."""

    stamp: int
    name: str


@dataclass
class FramePart(InputPartition):
    path: str
    stamp: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:", path) else (fs.LocalFileSystem(), path)


def listing(path: str, stamp: str = STAMP) -> list[Entry]:
    """The Parquet files under a folder, by frame; one without a stamp in its name is known by the time it was last changed. Hidden files and those that are being written (``_temporary``) are none; a folder that is not there yet has none."""
    store, root = _store(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        name = info.path[len(root) :].lstrip("/")
        at = re.search(stamp, name)
        if info.type == fs.FileType.File and name.endswith(".parquet") and not any(p.startswith(("_", ".")) for p in name.split("/")):
            found.append(Entry(int(at[1]) if at else int((info.mtime_ns or 0) // 10**9), name))
    return sorted(found, key=lambda e: (e.stamp, e.name))


def window(entries: list[Entry], newest: int) -> list[Entry]:
    """The files of the newest frames: what one look sees."""
    times = sorted({e.stamp for e in entries})[-newest:]
    return [e for e in entries if times and e.stamp >= times[0]]


def admitted(before: dict, after: dict) -> list[Entry]:
    """What the look ``after`` reads beyond the look ``before``, by the two offsets alone.

    An offset is what a look saw. A file that it did not see is new if its frame lies behind the
    oldest one seen then: what is older had its look, or never will, as a later look takes the
    newest frames only. Where a look saw fewer frames than it takes, it saw all there were, so
    whatever came since is new.
    """
    seen = {name for _, name in before["seen"]}
    floor = min((stamp for stamp, _ in before["seen"]), default=None) if before["full"] else None
    return [Entry(stamp, name) for stamp, name in after["seen"] if name not in seen and (floor is None or stamp > floor)]


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError(f"{FORMAT} needs a path")
        self.path, self.newest, self.stamp = options["path"].rstrip("/"), int(options.get("newest", NEWEST)), options.get("stamp", STAMP)
        if self.newest < 1:
            raise ValueError("newest must be one at least")

    def look(self) -> dict:
        seen = window(listing(self.path, self.stamp), self.newest)
        return {"seen": [[e.stamp, e.name] for e in seen], "full": len({e.stamp for e in seen}) >= self.newest}

    def parts(self, entries: list[Entry]) -> list[FramePart]:
        return [FramePart(f"{self.path}/{e.name}", e.stamp) for e in entries]


def _rows(part: FramePart, schema: StructType) -> Iterator[pa.RecordBatch]:
    """A file's rows in the columns that are asked for. The frame's time is that of its name where the file has none; other columns that it lacks are null."""
    store, path = _store(part.path)
    with store.open_input_file(path) as file:
        source = pq.ParquetFile(file)
        names = [f.name for f in schema]
        for batch in source.iter_batches(columns=[n for n in names if n in source.schema_arrow.names]):
            own = {n: batch.column(n) for n in batch.schema.names}
            if "frame_time" not in own:
                own["frame_time"] = pa.array([part.stamp] * batch.num_rows, pa.int64())
            kinds = _arrow(schema)
            columns = [own[f.name].cast(f.type) if f.name in own else pa.nulls(batch.num_rows, f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class FrameStream(DataSourceStreamReader):
    """Looks at the folder; each file of a new frame is one partition of the batch that admits it."""

    def __init__(self, options: _Options, schema: StructType) -> None:
        self.options, self.schema = options, schema

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"seen": [], "full": False}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.options.look()

    def partitions(self, start: dict, end: dict) -> list[FramePart]:
        return self.options.parts(admitted(start, end))

    def read(self, partition: FramePart) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.schema)

    def commit(self, end: dict) -> None:
        """Nothing is held beside the offsets, which the query's checkpoint keeps."""


class FrameBatch(DataSourceReader):
    """One look."""

    def __init__(self, options: _Options, schema: StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> list[FramePart]:
        return self.options.parts(admitted({"seen": [], "full": False}, self.options.look())) or [FramePart("", 0)]

    def read(self, partition: FramePart) -> Iterator[Any]:
        return _rows(partition, self.schema) if partition.path else iter(())


class FrameListing(DataSource):
    """``frame_listing``: frames as Parquet files in a folder, each file once, the newest frames of each look.

    Options: ``path``, a folder or URI that driver and executors share; ``newest``, the frames that a
    look takes (4); ``stamp``, a pattern whose group is a frame's time in a file's name. The schema
    may be given, and is that of samples otherwise.
    """

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.own = _Options(dict(options))

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameBatch(self.own, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FrameStream(self.own, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameListing)


def newest_frames(spark: SparkSession, folder: str, newest: int = NEWEST, schema: str = SAMPLES) -> DataFrame:
    """One look at a folder: the samples of its newest frames."""
    register(spark)
    return spark.read.format(FORMAT).schema(schema).option("path", folder).option("newest", newest).load()


def poll(spark: SparkSession, folder: str, schema: str = SAMPLES, newest: int = NEWEST) -> DataFrame:
    """Look after look as a stream: each file once, the newest frames of each look. After a restart from its checkpoint nothing is read twice or left out that a look would have taken."""
    register(spark)
    return spark.readStream.format(FORMAT).schema(schema).option("path", folder).option("newest", newest).load()


def frames_seen(samples: DataFrame, late: str = "30 minutes") -> DataFrame:
    """``frame_time, n, max_level`` of each frame of a stream once its time has passed by ``late``."""
    at = F.timestamp_seconds("frame_time")
    return samples.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", "5 minutes"), "frame_time").agg(F.count("*").alias("n"), F.max("level").alias("max_level")).select("frame_time", "n", "max_level")


def trigger(seconds: int = POLL_SECONDS) -> dict[str, str]:
    """For ``writeStream.trigger``: a look every so many seconds."""
    return {"processingTime": f"{seconds} seconds"}
