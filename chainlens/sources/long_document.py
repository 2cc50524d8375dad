"""Very long JSON documents, cut into small ones before they are parsed.

``from_json`` parses a document in one task and holds it whole.  Here a file is
read as the pieces that end at ``}``, by as many tasks as it has splits.  A
piece knows how many quotes it holds and how many ``{`` stand outside strings,
both if it begins outside a string and if it begins inside one.  Sums over the
pieces before it - within its split, plus one row per split - then give where
it really begins and how deep.

Pieces between two places of depth 2 or less make a text:

* one that begins and ends inside the member that holds the entries is an
  entry, and becomes a document of its own;
* the others are the frame: a document without its entries but the first,
  joined and parsed as any document, so what is wrong with it is found there.

All texts are as long as an entry (or a frame), however long the document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.operators.stored import stored

_PLACE = ("file", "block", "at")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The text between closing braces, its place, and what it holds."""
    text = F.regexp_replace("value", r"(?s)\\.", "")
    strings = '"[^"]*+("|$)'
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        F.col("_metadata.file_size").alias("file_size"),
        (F.octet_length("value") + F.lit(1)).cast("long").alias("bytes"),
        _count(text, '"').alias("quotes"),
        _count(F.regexp_replace(text, strings, ""), "{").alias("opened_outside"),
        _count(F.regexp_replace(F.concat(F.lit('"'), text), strings, ""), "{").alias("opened_inside"),
    )


def _carried(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``column`` over the pieces before, in the order of the file."""
    totals = rows.groupBy("file", "block").agg(F.sum(column).alias("_total"))
    # a row per split
    splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "block", F.coalesce(F.sum("_total").over(splits), F.lit(0)).alias("_start"))
    # a split's pieces
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(column).over(inside), F.lit(0))
    return rows.join(F.broadcast(starts), ["file", "block"]).withColumn(name, F.col("_start") + before).drop("_start")


def _marked(pieces: DataFrame) -> DataFrame:
    """For each piece its text's number, its document's, the depth before and behind it, and whether a text ends there."""
    rows = _carried(pieces.drop("value"), "bytes", "byte")
    rows = _carried(rows, "quotes", "quotes_before")
    inside = F.col("quotes_before") % 2
    # a last piece that no brace ended is one byte short of what it was counted for
    ended = F.col("byte") + F.col("bytes") <= F.col("file_size")
    inside_after = (inside + F.col("quotes")) % 2
    closes = (ended & (inside_after == 0)).cast("long")
    change = F.when(inside == 1, F.col("opened_inside")).otherwise(F.col("opened_outside")) - closes
    rows = stored(rows.select(*_PLACE, ended.alias("ended"), (inside_after == 1).alias("in_string"), change.alias("change")), "document-depths")
    rows = _carried(rows, "change", "before")
    after = F.col("before") + F.col("change")
    last = F.col("ended") & ~F.col("in_string") & (after <= 2)
    rows = rows.select(
        *_PLACE,
        "ended",
        "before",
        after.alias("after"),
        last.alias("last"),
        last.cast("long").alias("texts"),
        (last & (after <= 0)).cast("long").alias("documents"),
    )
    rows = stored(rows, "document-texts")
    return _carried(_carried(rows, "texts", "text_no"), "documents", "document_no")


def _or_error(good: Column, value: Column, message: str) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def split_documents(spark: SparkSession, path: str | list[str], member: str = "result") -> DataFrame:
    """``value``: JSON documents that together hold the entries of those at ``path``.

    The files are plain (not compressed) UTF-8 text, each with any number of
    documents one after the other, over any number of lines.  A document is an
    object whose ``member`` is an object of entries; it gives one document with
    all its members and the first entry, and one with each further entry.  Equal
    keys stay apart.  Empty files and blank text give no row.

    Memory is bounded by the longest entry, the longest text without a closing
    brace and one split of the file.  A file that ends inside an entry or with text
    that is no document, a brace too many, entries without a comma between them
    and another member that holds objects of objects stop the job here; other
    faults of a document are in the documents that come out of it, for the
    parser to find.
    """
    pieces = stored(_pieces(spark, path), "document-pieces")
    marked = _marked(pieces)
    text = F.concat("value", F.when(F.col("ended"), F.lit("}")).otherwise(F.lit("")))
    parts = marked.join(pieces.select(*_PLACE, "value"), list(_PLACE)).select(
        "file", "text_no", "document_no", "block", "at", "before", "after", "last", text.alias("text")
    )
    place = F.struct("block", "at")
    texts = parts.groupBy("file", "document_no", "text_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda x: x["text"]), "").alias("text"),
        F.min_by("before", place).alias("before"),
        F.max_by("after", place).alias("after"),
        F.bool_or("last").alias("whole"),
    )
    # what stands behind the last document
    rest = ~F.col("whole") & (F.col("before") == 0) & F.col("text").rlike(r"^\s*$")
    is_entry = F.col("whole") & (F.col("before") == 2) & (F.col("after") == 2)
    bare = F.regexp_replace("text", r"^\s*,", "")
    entry = _or_error(
        F.col("text").rlike(r"^\s*,"), F.concat(F.lit(f'{{"{member}":{{'), bare, F.lit("}}")), "entries of a JSON document without a comma between them"
    )

    # a text that opens the member of the entries, closed to be a document
    opening = F.concat(F.when(F.col("before") == 1, F.concat(F.lit("{"), bare)).otherwise(F.col("text")), F.lit("}}"))
    opens = (F.col("before") < 2) & (F.col("after") == 2)
    held = F.try_element_at(F.from_json(opening, "map<string,string>"), F.lit(member))
    frame = F.when(~F.col("whole"), _or_error(F.lit(False), F.col("text"), "a JSON file ends inside an entry, or with text that is no document"))
    frame = frame.when(F.col("after") < 0, _or_error(F.lit(False), F.col("text"), "a JSON document closes more braces than it opens"))
    frame = frame.when(
        opens, _or_error(F.startswith(held, F.lit("{")), F.col("text"), f"not a JSON document, or one with entries outside of '{member}'")
    ).otherwise(F.col("text"))
    # stored before it is filtered: the optimizer may evaluate an error before a filter beside it
    kind = F.when(is_entry, F.lit("entry")).when(rest, F.lit("rest")).otherwise(F.lit("frame"))
    value = F.when(is_entry, entry).when(rest, F.lit("")).otherwise(frame)
    values = stored(texts.select("file", "document_no", "text_no", kind.alias("kind"), value.alias("value")), "document-values")
    frames = (
        values.where(F.col("kind") == "frame")
        .groupBy("file", "document_no")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_no", "value"))), lambda x: x["value"]), "").alias("value"))
        .select("value")
    )
    return frames.unionByName(values.where(F.col("kind") == "entry").select("value"))
