"""Column storage profile (Q9/Q10: A9-A13, X7-X10, W2).

The reference prices a text column stored as hex: every character after
the ``0x`` prefix holds four bits, so a column costs
``(mean(length) - 2) * 4 / 8`` bytes per row, times the number of rows.
The mean skips NULLs but the row count does not; an all-NULL column costs
0.0; short decimal columns come out negative and stay in the total.

All columns are measured in **one** aggregation (one partial aggregate
per task, one final row); the single row is then unpivoted into one output
row per column.  The grand total for the percentages is a plain expression
over that one row, summed in column order like the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlens.schema import HEX_BITS_PER_CHAR, HEX_OVERHEAD_COLUMNS, HEX_PREFIX_CHARS

ROWS = "_rows"


def hex_bytes_per_row(mean_length: Column) -> Column:
    """``(mean_length - 2) * 4 / 8``; 0.0 when the mean is NULL."""
    return F.coalesce((mean_length - HEX_PREFIX_CHARS) * HEX_BITS_PER_CHAR / 8, F.lit(0.0))


def _measured(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: column ``_s<i>`` = bytes of ``columns[i]`` over all rows."""
    means = [F.avg(F.length(F.col(c))).alias(f"_m{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count(F.lit(1)).alias(ROWS), *means)
    return row.select(
        *[(hex_bytes_per_row(F.col(f"_m{i}")) * F.col(ROWS)).alias(f"_s{i}") for i in range(len(columns))]
    )


def _one_row_per_column(sizes: DataFrame, columns: Sequence[str], value_name: str, ids: list[str]) -> DataFrame:
    """Unpivot the ``_s<i>`` columns of the single row into named rows.

    ``unpivot`` plans an ``Expand``: one small generated method per output
    row, where an ``inline`` of one array of structs would build a single
    method too large to compile for wide tables.
    """
    long = sizes.unpivot(ids, [f"_s{i}" for i in range(len(columns))], "_slot", value_name)
    names = F.array(*[F.lit(c) for c in columns])
    index = F.substring(F.col("_slot"), 3, 6).cast("int") + 1
    return long.select(F.element_at(names, index).alias("column_name"), *ids, value_name)


def column_space_share(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q10: (column_name, space_saved, percentage_saved) for every column."""
    columns = list(columns or df.columns)
    sizes = _measured(df, columns)
    total = F.col("_s0")
    for i in range(1, len(columns)):
        total = total + F.col(f"_s{i}")
    rows = _one_row_per_column(sizes.select("*", total.alias("_total")), columns, "space_saved", ["_total"])
    return rows.select(
        "column_name", "space_saved", (F.col("space_saved") / F.col("_total") * 100).alias("percentage_saved")
    )


def column_space(df: DataFrame, columns: Sequence[str] = HEX_OVERHEAD_COLUMNS) -> DataFrame:
    """Q9: (column_name, size_bytes) for the named columns, in one pass."""
    return _one_row_per_column(_measured(df, list(columns)), list(columns), "size_bytes", [])


def column_space_from_share(share: DataFrame, columns: Sequence[str] = HEX_OVERHEAD_COLUMNS) -> DataFrame:
    """Q9 derived from a Q10 result, so a job needs one scan for both."""
    return share.where(F.col("column_name").isin(list(columns))).select(
        "column_name", F.col("space_saved").alias("size_bytes")
    )
