"""Cutting lineage, and reading tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share. Only where that is unset
    and the session is local, as in tests, a temporary folder takes its place."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pluvio-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows neither recomputes
    it nor depends on an executor that may be lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt_anew(df: DataFrame) -> DataFrame:
    """``df`` without Spark's knowledge of how its rows are dealt. No row moves, but a join then
    shuffles both sides, which is what lets adaptive execution split the partition of a hot key."""
    return df.coalesce(1 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
