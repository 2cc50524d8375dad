"""Top-k and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, by: str, *tie_keys: str) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties ordered by ``tie_keys``.

    Planned as ``TakeOrderedAndProject``: each task keeps its own ``k`` best
    rows, so only ``k`` rows per task travel, never the whole input.
    """
    return df.orderBy(F.col(by).desc(), *[F.col(c).asc() for c in tie_keys]).limit(k)


def ranked(df: DataFrame, by: str, *tie_keys: str, rank_col: str = "rank") -> DataFrame:
    """Number the rows of an already bounded result from 1 (largest first).

    The window has no partition key, so it runs in one task; use it only on
    outputs of :func:`top_k` (at most ``k`` rows).
    """
    w = Window.orderBy(F.col(by).desc(), *[F.col(c).asc() for c in tie_keys])
    return df.select(F.row_number().over(w).alias(rank_col), *df.columns)
