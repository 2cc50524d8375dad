"""Calendar reshaping of monthly results.

Inputs are monthly results keyed by 'MM/YYYY' text.  All of these run on
results with one row per month (or per month and category), i.e. a few
hundred rows however large the ledger is.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions.calendar import month_abbrev, parse_month_text
from chainlens.operators.stored import stored


def _dated(monthly: DataFrame, month_col: str) -> DataFrame:
    d = parse_month_text(F.col(month_col))
    return monthly.select(
        "*", F.year(d).alias("_year"), F.month(d).alias("_month"), d.alias("_date")
    )


def year_month_grid(monthly: DataFrame, value_col: str, month_col: str = "month") -> DataFrame:
    """All twelve months of every year present, 0 where a month is absent.

    -> (year INT, month INT, month_name STRING, <value_col>), in calendar
    order.  One pass over ``monthly``: values are gathered per year into a
    map of at most twelve entries, and ``explode(sequence(1, 12))`` spans the
    year; no self-join, so the input is computed once.
    """
    d = _dated(monthly, month_col)
    cells = d.groupBy(F.col("_year").alias("year"), F.col("_month").alias("month")).agg(
        F.sum(value_col).alias("_v")
    )
    years = cells.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct("month", "_v"))).alias("_by_month"))
    grid = years.select("year", "_by_month", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return grid.select(
        "year",
        "month",
        month_abbrev(F.make_date(F.col("year"), F.col("month"), F.lit(1))).alias("month_name"),
        F.coalesce(F.element_at(F.col("_by_month"), F.col("month")), F.lit(0)).alias(value_col),
    ).orderBy("year", "month")


def category_pivot(
    cells: DataFrame,
    value_col: str,
    categories: Sequence[str] | None = None,
    month_col: str = "month",
    category_col: str = "category",
) -> DataFrame:
    """(year, month) x category table of summed values, NULL where absent.

    ``cells`` holds one value per (month, category) or several to be summed.
    The columns are the categories that occur, in order.  Finding them takes a
    job before the result has a schema, so the summed cells - a row per month
    and category, however large the input - are stored by that job, and the
    input is not read again.  Pass ``categories`` when known, and nothing is
    stored.
    """
    d = _dated(cells, month_col)
    summed = d.groupBy(
        F.col("_year").alias("year"), F.col("_month").alias("month"), F.col(category_col).alias("_cat")
    ).agg(F.sum(value_col).alias("_v"))
    if categories is None:
        summed = stored(summed, "pivot-cells")
        # a row per category, as the columns of the result
        categories = [r["_cat"] for r in summed.select("_cat").distinct().orderBy("_cat").collect()]
    pivoted = summed.groupBy("year", "month").pivot("_cat", list(categories)).agg(F.sum("_v"))
    return pivoted.orderBy("year", "month")


def yearly_panels(
    monthly: DataFrame, value_col: str, drop_years: Iterable[int] = (), month_col: str = "month"
) -> DataFrame:
    """(year INT, month DATE, value) without ``drop_years``, by year then month.

    One frame holds every panel; select a year or ``partitionBy('year')``
    on write to get one panel per year.
    """
    d = _dated(monthly, month_col)
    dropped = list(drop_years)
    # the year stands behind a one-element explode: a filter on it would be pushed
    # through the aggregate, and the month's text made and parsed for every input row
    year = F.explode(F.array("_year")) if dropped else F.col("_year")
    out = d.select(year.alias("year"), F.col("_date").alias("month"), F.col(value_col))
    if dropped:
        out = out.where(~F.col("year").isin(dropped))
    return out.orderBy("year", "month")
