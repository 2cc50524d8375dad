"""Staged tables in the shared checkpoint folder, and small input helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.session import ensure_checkpoint_dir


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark deliver this package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(), "chainlens.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a task that was lost and run again re-reads the
    committed files and never repeats (or renumbers) what made them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)`` only, so that no other column of the input can clash; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from the columns ``taken``; Spark ignores case."""
    held = {c.lower() for c in taken}

    def free(name: str) -> str:
        while name.lower() in held:
            name = f"_{name}"
        return name

    return [free(n) for n in names]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Tables up to this size may be broadcast.
BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, row_bytes: int = 0, bytes_of: Column | None = None) -> DataFrame:
    """``df``, a staged table, with a broadcast hint if its rows add up to at most :data:`BROADCAST_BYTES`.

    The size is measured, as ``row_bytes`` a row or the sum of ``bytes_of``;
    a larger table is joined by a shuffle.
    """
    size = F.sum(bytes_of) if bytes_of is not None else F.count(F.lit(1)) * row_bytes
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= BROADCAST_BYTES else df
