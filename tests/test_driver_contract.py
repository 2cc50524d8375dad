"""The driver contract: entry() runs, and every query equals its SQL oracle.

Run at sf0.001 with a non-UTC session zone: the driver builds its own
session, and no result may depend on its time zone.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
CORE = E.catalog.QUERY_NAMES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def foreign_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", old)


def test_entry_runs(foreign_zone):
    df = E.entry(foreign_zone)
    rows = df.collect()
    assert df.columns == ["address", "value"]
    assert 0 < len(rows) <= 10


def test_every_query_has_an_oracle():
    assert set(CORE) <= set(E.queries())
    assert set(CORE) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_matches_oracle(foreign_zone, name):
    con = duckdb_connection(SF)
    ok, n, _, detail = compare(foreign_zone, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, detail
