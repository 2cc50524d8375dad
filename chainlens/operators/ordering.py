"""A total order that survives storage.

A sorted DataFrame loses its order when it is written and read again: readers
take files in any order, and split them.  Here rows are range-partitioned on
the sort keys, each partition is sorted and written as one file, and file
names ascend with the ranges, so (file name, row in the file) is the order.
Row numbers follow from it: the rows of the files before, and the place in the
file.  No task holds more than its range, and only one row per file is looked
at together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.operators.stored import stored_path


def write_ordered(df: DataFrame, path: str, keys: list[Column], fmt: str = "parquet", partitions: int | None = None, **options: str) -> None:
    """Write ``df`` below ``path`` so that file names, then lines, follow ``keys``.

    ``keys`` should end in columns that tell rows apart, or ties may come in
    any order.  Equal keys share a file.  ``partitions`` bounds the files
    (default: the session's shuffle partitions).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed.write.format(fmt).options(**options).save(path)


def read_numbered(spark: SparkSession, path: str, number: str = "row_number") -> DataFrame:
    """The rows that :func:`write_ordered` stored as Parquet, with their place in the order, from 1."""
    rows = spark.read.parquet(path)
    # the row as one value, so that no name of its columns can clash
    placed = rows.select(
        F.struct(*rows.columns).alias("_fields"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # a row per file
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_file")
    return joined.select((F.col("_start") + F.col("_at") + 1).alias(number), "_fields.*")


def numbered(df: DataFrame, keys: list[Column], number: str = "row_number") -> DataFrame:
    """``df`` with every row's place in the order of ``keys``, from 1, for results of any size."""
    spark = df.sparkSession
    path = stored_path(spark, "ordered")
    write_ordered(df, path, keys)
    return read_numbered(spark, path, number)
