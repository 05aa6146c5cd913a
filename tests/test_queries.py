"""Every query against its SQL on DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import difference, duck
from conftest import DATA

from pluvio.plans import catalog

SMALL = f"{DATA}/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL).toArrow(), duck(SMALL).execute(SQL[name]).to_arrow_table()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    """Those that SQL cannot express run and say something; their values are held in test_threat and test_streams_feeds."""
    found = QUERIES[name](spark, SMALL)
    assert found.columns and found.count() > 0


def test_the_whole_field_and_every_shift(spark):
    """All 1,600 cells of each of the 25 pins, and every shift between each two frames; beside test_sql, which holds the values."""
    field = QUERIES["motion_field"](spark, SMALL)
    assert {r["count"] for r in field.groupBy("pin_id").count().collect()} == {1600} and field.count() == 40_000
    for name, n in (("ncc_shift_all", 49), ("ncc_shift", 441)):
        shifts = QUERIES[name](spark, SMALL).groupBy("frame_time").count().collect()
        assert shifts and {r["count"] for r in shifts} == {n}
