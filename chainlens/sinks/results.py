"""Result writers and readers.

Two forms are offered:

* row files (``write_rows_json`` / ``write_csv``): written in parallel by
  the executors, one part file per partition - the form for any size;
* the reference's single JSON array per result, one document holding every
  row, e.g. ``[["09/2018", 16056742], ...]``:

  - ``write_json_array`` / ``read_json_array``: one line, through one task,
    for results that are bounded by what they are (top-k lists, one row per
    month), and for the reference's own files;
  - ``write_long_json_array`` / ``read_long_json_array``: any size.  The part
    files, one after the other, are the array; every element has a line of its
    own, so many tasks write it, and many read it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructType

from chainlens.functions.calendar import parse_month_text
from chainlens.operators.stored import stored


def run_stamp(now=None) -> str:
    """Time-stamped result suffix as in the reference (``%d-%m-%Y_%H_%M_%S``)."""
    import datetime

    return (now or datetime.datetime.now()).strftime("%d-%m-%Y_%H_%M_%S")


def json_text(df: DataFrame, name: str) -> Column:
    """JSON text of column ``name`` (strings quoted and escaped)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (ArrayType, StructType, MapType)):
        return F.coalesce(F.to_json(c), F.lit("null"))
    if isinstance(dtype, NumericType):
        return F.coalesce(c.cast("string"), F.lit("null"))
    # A one-element JSON array of the text, without its brackets: the
    # string quoted and escaped by Spark's own JSON writer.
    text = c if isinstance(dtype, StringType) else c.cast("string")
    quoted = F.regexp_extract(F.to_json(F.array(text)), r"^\[(.*)\]$", 1)
    return F.when(c.isNull(), F.lit("null")).otherwise(quoted)


def json_array(df: DataFrame, elements: list[Column], order: list[Column]) -> DataFrame:
    """One row, column ``value``: ``[e1, e2, ...]`` with rows in ``order``.

    ``elements`` are JSON texts (see :func:`json_text`); several elements
    per row are written as a JSON array ``[a, b]``, one as the bare value.
    """
    item = elements[0] if len(elements) == 1 else F.concat(F.lit("["), F.concat_ws(", ", *elements), F.lit("]"))
    keyed = df.select(F.struct(*[o.alias(f"_k{i}") for i, o in enumerate(order)]).alias("_k"), item.alias("_e"))
    agg = keyed.agg(F.sort_array(F.collect_list(F.struct("_k", "_e"))).alias("_items"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_items", lambda s: s.getField("_e")), ", "), F.lit("]"))
    return agg.select(text.alias("value"))


def write_json_array(df: DataFrame, path: str, elements: list[Column], order: list[Column]) -> None:
    """Write :func:`json_array` of ``df`` as one text file under ``path``."""
    json_array(df, elements, order).coalesce(1).write.mode("overwrite").text(path)


def write_long_json_array(df: DataFrame, path: str, elements: list[Column], order: list[Column], partitions: int | None = None) -> None:
    """Write ``df`` as one JSON array, rows in ``order``, by many tasks.

    ``order`` are columns to sort by, ascending, as in :func:`json_array`.
    Part files in the order of their names make up the document: ``[`` and the
    first element, then ``, `` and an element a line, then ``]``.  A range of
    ``order`` is one part, and no task or row holds more.  Rows that tie come
    in any order; an empty result is ``[]``.
    """
    spark = df.sparkSession
    item = elements[0] if len(elements) == 1 else F.concat(F.lit("["), F.concat_ws(", ", *elements), F.lit("]"))
    keys = [f"_k{i}" for i in range(len(order))]
    items = stored(
        df.select(item.alias("_item"), *[o.alias(k) for k, o in zip(keys, order, strict=True)]).withColumn(
            "_id", F.monotonically_increasing_id()
        ),
        "json-array",
    )
    first = items.orderBy(*keys, "_id").select("_id").first()
    if first is None:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    opening = F.when(F.col("_id") == first[0], "[").otherwise(", ")
    lines = items.select(F.lit(0).alias("_end"), *keys, "_id", F.concat(opening, "_item").alias("value"))
    nothing = [F.lit(None).cast(items.schema[k].dataType).alias(k) for k in (*keys, "_id")]
    end = spark.range(1).select(F.lit(1).alias("_end"), *nothing, F.lit("]").alias("value"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = ["_end", *keys, "_id"]
    placed = lines.unionByName(end).repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    placed.select("value").write.mode("overwrite").text(path)


def write_scam_months(by_month: DataFrame, path: str) -> None:
    """Q6 (month, id, category, ether) as one array ``[[["09/2016", ["5622", "Scamming"]], 1.67E22], ...]``, by month, id and category."""
    shaped = by_month.select(F.array("id", "category").alias("_scam"), "month", "id", "category", "ether")
    key = F.concat(F.lit("["), json_text(shaped, "month"), F.lit(", "), json_text(shaped, "_scam"), F.lit("]"))
    order = [parse_month_text(F.col("month")), F.col("id"), F.col("category")]
    write_long_json_array(shaped, path, [key, json_text(shaped, "ether")], order)


def read_long_json_array(spark: SparkSession, path: str | list[str], element_type: str = "array<string>") -> DataFrame:
    """Rows (column ``item``) of an array with an element a line, as :func:`write_long_json_array` writes it.

    Lines are read and parsed on their own, so a large document is split over
    tasks.  A line that is no element stops the job.
    """
    lines = spark.read.text(path)
    element = F.regexp_replace("value", r"^(\[|, )", "")
    texts = lines.where(~F.col("value").isin("]", "[]", "")).select(element.alias("_text"))
    # parsed as an array of one, so that elements of any type are read alike
    parsed = F.from_json(F.concat(F.lit("["), "_text", F.lit("]")), f"array<{element_type}>", {"mode": "FAILFAST"})
    return texts.select(F.get(parsed, 0).alias("item"))


def read_json_array(spark: SparkSession, path: str | list[str], element_type: str = "array<string>") -> DataFrame:
    """Rows of JSON-array result files, one row per element (column ``item``).

    Each file is one document (the reference's result format); nested
    values of a ``string`` element keep their JSON text, so mixed rows like
    ``[["5622", "Scamming"], 1.67e+22]`` read as ``array<string>``.
    """
    return parse_json_array(spark.read.text(path, wholetext=True), element_type)


def parse_json_array(docs: DataFrame, element_type: str = "array<string>", col: str = "value") -> DataFrame:
    """Rows of JSON-array documents already in a DataFrame (column ``item``)."""
    return docs.select(F.explode(F.from_json(F.col(col), f"array<{element_type}>")).alias("item"))


def pairs_from_text(rows: DataFrame, col: str = "item", names: tuple[str, str] = ("month", "value")) -> DataFrame:
    """Split ``"09/2018,3.7e+18"`` texts into two columns (F17), value as DOUBLE."""
    parts = F.split(F.col(col), ",", 2)
    return rows.select(F.get(parts, 0).alias(names[0]), F.get(parts, 1).cast("double").alias(names[1]))


def write_rows_json(df: DataFrame, path: str) -> None:
    """JSON lines, one part file per partition (any size)."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Headed CSV; ``single_file`` (bounded results only) coalesces to one part."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", "true").csv(path)
