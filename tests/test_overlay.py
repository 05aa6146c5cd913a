"""Overlays and the frames that follow them, on odd and crowded tables."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
from compare import difference

from pluvio.plans import catalog

START = dt.datetime(2024, 1, 1, 5)


def crowded(spark, folder):
    """Events within few minutes: many at one time, at the very edge of six minutes, twice under one id, without an id or a time."""
    odd = random.Random(3)
    rows = [(n, START + dt.timedelta(seconds=odd.choice([0, 60, 359.999999, 360, 360.000001, 719, 720, 1080, 2400]) + odd.choice([0, 0, 0.5])), odd.choice(["view", "click", "error"])) for n in range(300)]
    rows += [(None, START + dt.timedelta(seconds=2400), "click"), (None, START, "view"), (900, None, "view"), (901, None, "click"), (902, START + dt.timedelta(days=1), "view"), (10, START + dt.timedelta(days=2), "view"), (903, START + dt.timedelta(days=2), "click")]
    spark.createDataFrame([(*r, 1, 1.0, "") for r in rows], "event_id long, ts timestamp_ntz, event_type string, user_id long, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_overlays_of_a_crowd_equal_their_sql(spark, tmp_path):
    folder = crowded(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    got = catalog.queries()["asof_overlay"](spark, folder)
    assert difference(got.toArrow(), con.execute(catalog.oracle_sql()["asof_overlay"]).to_arrow_table()) is None
    assert got.count() > 50


def test_overlays_and_frames_are_never_paired(spark, tmp_path):
    plan = catalog.queries()["asof_overlay"](spark, crowded(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan
