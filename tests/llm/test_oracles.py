"""Registered queries with SQL equal their SQL over the driver's tables."""

from __future__ import annotations

import os

import pytest

from chainlens.llm import registry
from oracle_compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    ok, n, _, detail = compare(spark, duckdb_connection(SF), name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    assert ok and n > 0, detail
