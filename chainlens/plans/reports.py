"""Report tables Q11-Q18 over query results, and golden-file replays.

These take the (small) results of Q1-Q8 - either DataFrames straight from
:mod:`chainlens.plans.queries` or rows read back from result files with
:func:`chainlens.sinks.results.read_json_array` - and reshape them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.operators.aggregate import number_total, part_sums
from chainlens.operators.calendar_grid import category_pivot, year_month_grid, yearly_panels
from chainlens.operators.ordering import numbered
from chainlens.operators.topk import ranked
from chainlens.sinks.results import pairs_from_text
from chainlens.functions.calendar import month_text
from chainlens.schema import PANEL_DROP_YEARS

# The reference drops its last, partial year (one month) from the panels.
REFERENCE_PANEL_DROP = PANEL_DROP_YEARS


def count_grid(monthly_counts: DataFrame) -> DataFrame:
    """Q11: Q1 on a dense year x 12-month grid -> (year, month, month_name, n)."""
    return year_month_grid(monthly_counts, "n")


def average_grid(monthly_avgs: DataFrame) -> DataFrame:
    """Q12: Q2 on the same grid -> (year, month, month_name, avg_value)."""
    return year_month_grid(monthly_avgs, "avg_value")


def ranked_services(top: DataFrame) -> DataFrame:
    """Q13: rank (from 1), address, value of a Q3 result."""
    return ranked(top, "value", "address")


def ranked_miners(top: DataFrame) -> DataFrame:
    """Q14: rank (from 1), miner, size of a Q4 result."""
    return ranked(top, "size", "miner")


def scam_table(top: DataFrame) -> DataFrame:
    """Q15: a Q5 result as a flat table (scam_id, scam_type, ether)."""
    return top.select(F.col("id").alias("scam_id"), F.col("category").alias("scam_type"), "ether")


def scam_pivot(by_month: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Q16: ether per (year, month) x category from a Q6 result, NULL where absent."""
    return category_pivot(by_month, "ether", categories)


def scam_pivot_exact(base: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Q16 from :func:`~chainlens.plans.queries.scam_month_base`.

    Sums the exact parts per (month, category) first, so every pivot cell
    is one correctly rounded DOUBLE whatever the partitioning.
    """
    cells = (
        base.where(F.col("month").isNotNull())
        .groupBy("month", "category")
        .agg(*part_sums("ether"))
        .select(month_text(F.col("month")).alias("month"), "category", number_total("ether").alias("ether"))
    )
    return category_pivot(cells, "ether", categories)


def ether_order() -> list[Column]:
    """By ether, largest first; ties by month, id and category."""
    return [F.col("ether").desc(), F.col("month"), F.col("id"), F.col("category")]


def scam_months_by_ether(by_month: DataFrame) -> DataFrame:
    """A Q6 result sorted by ether -> (row_number, month, id, category, ether).

    The order is stored as range-partitioned files and read back as row
    numbers, as a DataFrame's own order does not outlive the next exchange.
    """
    return numbered(by_month.select("month", "id", "category", "ether"), ether_order())


def gas_price_panels(monthly: DataFrame, drop_years: Iterable[int] = REFERENCE_PANEL_DROP) -> DataFrame:
    """Q17: Q7 per year -> (year, month DATE, avg_gas_price), ``drop_years`` removed."""
    return yearly_panels(monthly, "avg_gas_price", drop_years)


def gas_panels(monthly: DataFrame, drop_years: Iterable[int] = REFERENCE_PANEL_DROP) -> DataFrame:
    """Q18: Q8 per year -> (year, month DATE, avg_gas), ``drop_years`` removed."""
    return yearly_panels(monthly, "avg_gas", drop_years)


# ---- replays of the reference's JSON-array result files (S12, F15-F18) ----


def counts_from_rows(rows: DataFrame) -> DataFrame:
    """``[["09/2018", 16056742], ...]`` (read as array<string>) -> (month, n)."""
    item = F.col("item")
    return rows.select(F.get(item, 0).alias("month"), F.get(item, 1).cast("bigint").alias("n"))


def averages_from_rows(rows: DataFrame) -> DataFrame:
    """``["09/2018,3.7e+18", ...]`` (read as string) -> (month, avg_value)."""
    return pairs_from_text(rows, "item", ("month", "avg_value"))


def month_values_from_rows(rows: DataFrame, value_col: str) -> DataFrame:
    """``[["01/2016", "56596270931.3"], ...]`` -> (month, <value_col> DOUBLE)."""
    item = F.col("item")
    return rows.select(F.get(item, 0).alias("month"), F.get(item, 1).cast("double").alias(value_col))


def top_from_rows(rows: DataFrame, key: str, value: str, value_type: str) -> DataFrame:
    """``[["0xaa..", 8415...], ...]`` -> (key, value) typed as ``value_type``."""
    item = F.col("item")
    return rows.select(F.get(item, 0).alias(key), F.get(item, 1).cast(value_type).alias(value))


def scam_months_from_rows(rows: DataFrame) -> DataFrame:
    """Q6 from ``[[["09/2016", ["5622", "Scamming"]], 1.67e+22], ...]`` (read as array<string>) -> (month, id, category, ether)."""
    key = F.from_json(F.get(F.col("item"), 0), "array<string>")
    scam = F.from_json(F.get(key, 1), "array<string>")
    return rows.select(
        F.get(key, 0).alias("month"),
        F.get(scam, 0).alias("id"),
        F.get(scam, 1).alias("category"),
        F.get(F.col("item"), 1).cast("double").alias("ether"),
    )


def scams_from_rows(rows: DataFrame) -> DataFrame:
    """Q15 from ``[[["5622", "Scamming"], 1.67e+22], ...]`` -> (scam_id, scam_type, ether)."""
    key = F.from_json(F.get(F.col("item"), 0), "array<string>")
    return rows.select(
        F.get(key, 0).alias("scam_id"),
        F.get(key, 1).alias("scam_type"),
        F.get(F.col("item"), 1).cast("double").alias("ether"),
    )
