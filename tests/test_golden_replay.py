"""Report queries replayed on published result files (tests/golden).

The files are results of one run over the full public ledger, in the
single-JSON-array result format; they exercise the reader (S12) and the
report reshapes Q11-Q17 at their real shapes.
"""

from __future__ import annotations

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chainlens.operators import profile
from chainlens.plans import reports as R
from chainlens.sinks.results import json_array, json_text, parse_json_array, read_json_array

GOLDEN = os.path.join(os.path.dirname(__file__), "golden")


def golden(name):
    return os.path.join(GOLDEN, name)


def test_count_grid_on_published_counts(spark):
    monthly = R.counts_from_rows(read_json_array(spark, golden("monthly_counts.json")))
    assert monthly.count() == 42
    assert monthly.agg(F.sum("n")).first()[0] == 369_817_358
    grid = R.count_grid(monthly).collect()
    assert len(grid) == 60  # 2015..2019, twelve months each
    assert sum(r.n for r in grid) == 369_817_358
    assert max(grid, key=lambda r: r.n)[:3] == (2018, 1, "Jan")
    assert [r.n for r in grid if r.year == 2015][:7] == [0] * 7


def test_average_grid_on_published_text_pairs(spark):
    rows = read_json_array(spark, golden("monthly_averages.json"), element_type="string")
    monthly = R.averages_from_rows(rows)
    grid = {(r.year, r.month): r.avg_value for r in R.average_grid(monthly).collect()}
    assert len(grid) == 60
    assert grid[(2015, 8)] == pytest.approx(4.8052118459597475e20)
    assert grid[(2019, 2)] == 0.0


def test_gas_price_panels_drop_partial_year(spark):
    monthly = R.month_values_from_rows(read_json_array(spark, golden("monthly_gas_price.json")), "avg_gas_price")
    panels = R.gas_price_panels(monthly).collect()  # drops 2019 like the reference
    assert len(panels) == 41
    assert sorted({r.year for r in panels}) == [2015, 2016, 2017, 2018]
    keys = [(r.year, r.month) for r in panels]
    assert keys == sorted(keys)


def test_ranked_services_exact_26_digits(spark):
    top = R.top_from_rows(read_json_array(spark, golden("top_services.json")), "address", "value", "decimal(38,0)")
    ranked = R.ranked_services(top).collect()
    assert [r.rank for r in ranked] == list(range(1, 11))
    assert ranked[0].value == Decimal("84155363699941767867374641")


def test_scam_table_and_json_round_trip(spark):
    flat = R.scams_from_rows(read_json_array(spark, golden("top_scams.json"))).collect()
    assert len(flat) == 15
    kinds = {}
    for r in flat:
        kinds[r.scam_type] = kinds.get(r.scam_type, 0) + 1
    assert kinds == {"Phishing": 10, "Scamming": 4, "Fake ICO": 1}
    assert flat[0] == ("5622", "Scamming", 1.6709083588072915e22)

    # write the same rows back in the result format and read them again
    df = spark.createDataFrame(flat).select(
        F.array("scam_id", "scam_type").alias("_key"), "ether", "scam_id", "scam_type"
    )
    doc = json_array(df, [json_text(df, "_key"), json_text(df, "ether")], [-F.col("ether"), F.col("scam_id")])
    again = R.scams_from_rows(parse_json_array(doc)).collect()
    assert again == flat


def test_number_column_reproduces_published_overhead(spark):
    # 7,000,001 block numbers 0..7,000,000 as text
    blocks = spark.range(7_000_001).select(F.col("id").cast("string").alias("number"))
    (name, space, pct) = profile.column_space_share(blocks).first()
    assert (name, space, pct) == ("number", 16944447.5, 100.0)


def test_json_array_holds_every_row(spark):
    df = spark.range(50).select(F.col("id"))
    doc = json_array(df, [json_text(df, "id")], [F.col("id")]).first()[0]
    assert doc == "[" + ", ".join(str(i) for i in range(50)) + "]"
