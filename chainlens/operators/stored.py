"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chainlens.session import ensure_checkpoint_dir


def stored_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table called ``name``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: written as Parquet and read back.

    What several later jobs need is not computed by each of them, and a lost
    executor loses none of it.
    """
    path = stored_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
