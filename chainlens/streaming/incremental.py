"""Q1/Q2 kept current while transaction files keep arriving.

A ledger export grows by appending files.  Instead of re-reading all of
them, the monthly counts and value sums (Q1, Q2) can be maintained by a
Structured Streaming query over the folder: the same parser, rules and
aggregate as the batch questions.  There is no watermark, as historical files
arrive in any order; the state has one row per month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from chainlens.functions.calendar import month_text
from chainlens.operators.aggregate import number_mean
from chainlens.plans.queries import monthly_base
from chainlens.sources.ledger import parse_transactions

LINE_SCHEMA = StructType([StructField("value", StringType(), True)])


def read_transaction_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LINE_SCHEMA).format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def monthly_time_analysis(lines: DataFrame) -> DataFrame:
    """Streaming (month, n, avg_value): Q1's count and Q2's mean per month.

    The state is one row per month, so no month is ever closed: rows may come
    in any order.
    """
    base = monthly_base(parse_transactions(lines))
    mean = F.when(F.col("n_value") > 0, number_mean("value", "n_value"))
    return base.select(month_text(F.col("month")).alias("month"), "n", mean.alias("avg_value"))


def start_monthly_time_analysis(
    spark: SparkSession, source: str, output: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Keep the whole table current, as Parquet: each batch writes ``output/batch=N``.

    ``checkpoint`` must be a shared, durable folder: offsets and the state
    store live there, so a restarted driver or lost executor resumes without
    double counting.  A batch that is repeated overwrites its own folder; the
    largest number is the table (:func:`read_monthly_time_analysis`).
    """

    def put(months: DataFrame, batch: int) -> None:
        months.coalesce(1).write.mode("overwrite").parquet(f"{output}/batch={batch}")

    writer = monthly_time_analysis(read_transaction_stream(spark, source)).writeStream.outputMode("complete")
    writer = writer.foreachBatch(put).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_monthly_time_analysis(spark: SparkSession, output: str) -> DataFrame:
    """The table as of the last batch."""
    batches = spark.read.parquet(output)
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).first()[0]).drop("batch")
