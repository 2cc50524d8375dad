"""scams.json reader.

The document maps an address to an entry ``{id, name, url, coin, category,
[subcategory], status, addresses: [...]}``.  The reference flattens it on
the driver into one comma-joined text row per listed address and re-splits
those rows; here the document is parsed with ``from_json`` on the
executors and the same row rules are applied as column predicates:

* every value is rendered like Python ``str()``: JSON null -> ``'None'``;
* category ``'Scam'`` becomes ``'Scamming'``;
* a missing ``subcategory`` becomes ``''``;
* a row survives only if its id is all digits and no field contains ','
  (a comma would change the field count of the reference's text row).

Anything else that is wrong stops the job with an error: a line that is not
a JSON document with ``result``, an entry without one of the required keys,
``addresses`` that are not an array.  Blank lines are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.functions.parse import is_digits
from chainlens.schema import SCAM_FIELDS, SCAM_RECODE
from chainlens.sources.long_document import split_documents

# Every entry value is kept as its JSON text, so numbers, nulls and the
# nested address list all survive parsing.
SCAM_RESULT_TYPE = "map<string, map<string, string>>"
SCAM_DOCUMENT_SCHEMA = f"struct<result: {SCAM_RESULT_TYPE}>"
REQUIRED_KEYS = ("id", "name", "url", "coin", "category", "addresses", "status")


def read_scams(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Scam rows from JSON documents.

    ``multiline=False`` reads one document per line (the reference's file is
    one line; several lines are several documents, parsed in parallel).
    ``multiline=True`` reads each file as one document.
    """
    return parse_scams(spark.read.text(path, wholetext=multiline))


def read_long_scams(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scam rows from documents of any length, each read and parsed by many tasks.

    Takes what ``read_scams`` takes in either form, in plain text files; see
    ``split_documents`` for what stops the job besides the rules above.
    """
    return parse_scams(split_documents(spark, path))


def _str(entry: Column, key: str) -> Column:
    """Python ``str(entry[key])``; NULL when the key is absent."""
    return F.when(
        F.map_contains_key(entry, key), F.coalesce(F.try_element_at(entry, F.lit(key)), F.lit("None"))
    )


def _or_error(value: Column, message: Column, kind: str) -> Column:
    return F.when(value.isNull(), F.raise_error(message).cast(kind)).otherwise(value)


def parse_scams(docs: DataFrame, line_col: str = "value", keep_commas: bool = False) -> DataFrame:
    """One row per (entry, listed address): the eight fields of SCAM_FIELDS."""
    text = F.col(line_col)
    result = F.from_json(text, SCAM_DOCUMENT_SCHEMA, {"mode": "FAILFAST"}).getField("result")
    message = F.lit("a scam list line is not a JSON document with 'result'")
    # not a filter: the optimizer may evaluate the error before it
    result = F.when(F.trim(text) == "", F.from_json(F.lit("{}"), SCAM_RESULT_TYPE)).otherwise(
        _or_error(result, message, SCAM_RESULT_TYPE)
    )
    entries = docs.select(result.alias("_result")).select(F.explode("_result").alias("key", "e"))
    e = F.col("e")
    for key in REQUIRED_KEYS:
        e = F.when(F.map_contains_key(F.col("e"), key), e).otherwise(
            F.raise_error(F.concat(F.lit(f"scam entry without '{key}': "), F.col("key"))).cast("map<string,string>")
        )
    entries = entries.select("key", e.alias("e"))
    e = F.col("e")
    listed = F.from_json(F.try_element_at(e, F.lit("addresses")), "array<string>")
    not_array = F.concat(F.lit("scam entry whose addresses are not an array: "), F.col("key"))
    category = _str(e, "category")
    rows = entries.select(
        _str(e, "id").alias("id"),
        _str(e, "name").alias("name"),
        _str(e, "url").alias("url"),
        _str(e, "coin").alias("coin"),
        F.when(category == SCAM_RECODE[0], F.lit(SCAM_RECODE[1])).otherwise(category).alias("category"),
        F.when(F.map_contains_key(e, "subcategory"), _str(e, "subcategory"))
        .otherwise(F.lit(""))
        .alias("subcategory"),
        F.explode(_or_error(listed, not_array, "array<string>")).alias("address"),
        _str(e, "status").alias("status"),
    ).select(*SCAM_FIELDS)
    rule = is_digits(F.col("id"))
    if not keep_commas:
        for c in SCAM_FIELDS:
            rule = rule & ~F.coalesce(F.col(c), F.lit("None")).contains(",")
    return rows.where(rule)


def scam_addresses(scams: DataFrame) -> DataFrame:
    """The join side used by the scam queries: (address, id, category)."""
    return scams.select("address", "id", "category")
