"""Stages that much else builds on, written once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``, which driver and executors share.

    Only where that is unset and the session is local, as in tests, a temporary folder takes its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pluvio-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder: what follows plans from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
