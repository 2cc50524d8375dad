"""Ledger files presented over the driver's star-schema tables.

The driver ships TPC-H-like Parquet tables, not ledger files.  These
functions derive ledger-shaped inputs from them with Spark, so every query
can be run - and checked against SQL - on data whose size grows with the
tables:

* transactions: one valid line per ``lineitem`` row, plus whole tables
  turned into lines that break exactly one rule each (see
  :data:`TRANSACTION_FAMILIES`);
* contracts: one line per ``supplier`` and per ``nation`` (the latter
  repeat supplier addresses, so joins fan out), plus broken lines;
* blocks: one line per ``orders`` row, plus broken lines;
* scams: one JSON document per line, one entry per ``supplier``.

Addresses are ``0xs<key>`` (supplier/contract side) so the families meet in
joins.  The SQL oracles in ``__spark_entry__`` rebuild the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.schema import BLOCK_FIELDS, CONTRACT_FIELDS, TRANSACTION_FIELDS

# Which rule each transaction family breaks (all other rules hold).
TRANSACTION_FAMILIES = {
    "lineitem": "none",
    "customer": "block number is not digits",
    "part": "value is not numeric-like ('<n>e3')",
    "supplier": "gas price is empty",
    "nation": "block time is not numeric ('bad')",
    "region": "block time is numeric-like but not an integer ('<n>.5')",
    "orders": "16 fields (quoted comma in input)",
    "events": "14 fields",
}

EPOCH_1995 = 788918400  # 1995-01-01T00:00:00Z
EPOCH_1996 = 820454400  # 1996-01-01T00:00:00Z
EPOCH_1997_07 = 867715200  # 1997-07-01T00:00:00Z


_TABLES: dict[tuple[str, str], DataFrame] = {}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, resolved once per application (file listing and footer
    reads are not repeated for every derived view)."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(key[1])
    return _TABLES[key]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _line(cols: list[Column]) -> Column:
    # concat_ws skips NULLs, so every field is made non-null text first.
    return F.concat_ws(",", *[_text(c) for c in cols]).alias("value")


def _addr(key: Column) -> Column:
    return F.concat(F.lit("0xs"), key.cast("string"))


def _epoch(ts: Column) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ read as UTC wall-clock time.

    Built from the date and the time-of-day fields, which do not depend on
    the session time zone (a cast to TIMESTAMP would).
    """
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _zeros(n: int) -> Column:
    return F.lit("0" * n)


def _tx_fields(**given: Column) -> list[Column]:
    return [given.get(name, F.lit("")) for name in TRANSACTION_FIELDS]


def transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transaction lines (column ``value``) derived from the tables."""
    t = lambda name: load_table(spark, sf_dir, name)
    header = spark.range(1).select(F.lit(",".join(TRANSACTION_FIELDS)).alias("value"))

    li = t("lineitem")
    valid = li.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0x"), li.l_orderkey, F.lit("_"), li.l_linenumber),
                nonce=li.l_linenumber,
                block_hash=F.concat(F.lit("0xb"), li.l_orderkey),
                block_number=li.l_orderkey,
                transaction_index=li.l_linenumber,
                from_address=F.concat(F.lit("0xp"), li.l_partkey),
                to_address=_addr(li.l_suppkey),
                value=F.concat(F.round(li.l_extendedprice * 100).cast("bigint"), _zeros(16)),
                gas=li.l_quantity.cast("bigint") * 1000,
                gas_price=li.l_linenumber.cast("bigint") * 1000000000 + li.l_partkey,
                input=F.lit("0x"),
                block_timestamp=_epoch(li.l_shipdate),
            )
        )
    )

    cu = t("customer")
    bad_block = cu.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0xc"), cu.c_custkey),
                block_number=F.concat(F.lit("c"), cu.c_custkey),
                to_address=_addr(cu.c_nationkey),
                value=F.concat(cu.c_custkey, _zeros(16)),
                gas=F.lit(21000),
                gas_price=(cu.c_nationkey + 1).cast("bigint") * 1000000000,
                block_timestamp=F.lit(EPOCH_1995) + cu.c_custkey * 6007,
            )
        )
    )

    pa = t("part")
    bad_value = pa.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0xq"), pa.p_partkey),
                block_number=pa.p_partkey,
                to_address=_addr(pa.p_size),
                value=F.concat(pa.p_size, F.lit("e3")),
                gas=pa.p_size + 30000,
                gas_price=pa.p_size.cast("bigint") * 100000000,
                block_timestamp=F.lit(EPOCH_1996) + pa.p_partkey * 3607,
            )
        )
    )

    su = t("supplier")
    bad_gas_price = su.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0xu"), su.s_suppkey),
                block_number=su.s_suppkey,
                to_address=_addr(su.s_suppkey),
                value=F.concat(su.s_suppkey, _zeros(15)),
                gas=F.lit(50000),
                block_timestamp=F.lit(EPOCH_1997_07) + su.s_suppkey * 86400,
            )
        )
    )

    na = t("nation")
    bad_time = na.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0xn"), na.n_nationkey),
                block_number=na.n_nationkey,
                to_address=_addr(na.n_nationkey),
                value=F.concat(na.n_nationkey + 1, _zeros(18)),
                gas=F.lit(60000),
                gas_price=F.lit(1000000000),
                block_timestamp=F.lit("bad"),
            )
        )
    )

    re = t("region")
    fractional_time = re.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0xr"), re.r_regionkey),
                block_number=re.r_regionkey,
                to_address=_addr(re.r_regionkey),
                value=F.concat(re.r_regionkey + 1, _zeros(20)),
                gas=F.lit(70000),
                gas_price=F.lit(1000000000),
                block_timestamp=F.concat(F.lit(900000000) + re.r_regionkey, F.lit(".5")),
            )
        )
    )
    empty = re.select(F.lit("").alias("value"))

    od = t("orders")
    quoted_comma = od.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0xo"), od.o_orderkey),
                block_number=od.o_orderkey,
                to_address=_addr(od.o_custkey),
                value=F.lit("1"),
                gas=F.lit(1),
                gas_price=F.lit(1),
                input=F.lit('"0x,1"'),
                block_timestamp=_epoch(od.o_orderdate),
            )
        )
    )

    ev = t("events")
    short = ev.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0xe"), ev.event_id),
                block_number=ev.event_id,
                to_address=_addr(ev.user_id),
                value=F.lit("1"),
                gas=F.lit(1),
                gas_price=F.lit(1),
                block_timestamp=_epoch(ev.ts),
            )[:-1]
        )
    )

    return (
        header.unionByName(valid)
        .unionByName(bad_block)
        .unionByName(bad_value)
        .unionByName(bad_gas_price)
        .unionByName(bad_time)
        .unionByName(fractional_time)
        .unionByName(empty)
        .unionByName(quoted_comma)
        .unionByName(short)
    )


def contract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw contract lines: suppliers, nations (repeating addresses), broken lines."""
    header = spark.range(1).select(F.lit(",".join(CONTRACT_FIELDS)).alias("value"))
    su = load_table(spark, sf_dir, "supplier")
    na = load_table(spark, sf_dir, "nation")
    re = load_table(spark, sf_dir, "region")
    suppliers = su.select(
        _line([_addr(su.s_suppkey), F.lit("0x6060"), F.lit(""), F.lit("false"), F.lit("false"), su.s_nationkey])
    )
    repeats = na.select(
        _line([_addr(na.n_nationkey), F.lit("0x6061"), F.lit(""), F.lit("false"), F.lit("true"), na.n_regionkey])
    )
    seven = re.select(
        _line(
            [
                F.concat(F.lit("0xr"), re.r_regionkey),
                F.lit("0x60"),
                F.lit('"0x1,0x2"'),
                F.lit("false"),
                F.lit("false"),
                re.r_regionkey,
            ]
        )
    )
    return header.unionByName(suppliers).unionByName(repeats).unionByName(seven)


def block_columns(orders: DataFrame) -> DataFrame:
    """The 19 block columns as text (NULL where the file field is empty)."""
    o = orders

    def h(c: Column) -> Column:
        return F.concat(F.lit("0x"), F.sha2(c.cast("string"), 256))

    cols = {
        "number": o.o_orderkey,
        "hash": h(o.o_orderkey),
        "parent_hash": h(o.o_orderkey - 1),
        "nonce": F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(o.o_custkey)), 16, "0")),
        "sha3_uncles": h(o.o_orderstatus),
        "logs_bloom": F.concat(F.lit("0x"), F.repeat(F.sha2(o.o_orderpriority, 256), 8)),
        "transactions_root": h(F.concat(F.lit("t"), o.o_orderkey)),
        "state_root": F.when(o.o_orderstatus != "P", h(F.concat(F.lit("s"), o.o_orderkey))),
        "receipts_root": h(F.concat(F.lit("r"), o.o_orderkey)),
        "miner": F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(o.o_custkey)), 40, "0")),
        "difficulty": F.floor(o.o_totalprice) * 1000,
        "total_difficulty": F.floor(o.o_totalprice * 100),
        "size": F.floor(o.o_totalprice),
        "extra_data": F.when(
            o.o_orderpriority != "5-LOW", F.concat(F.lit("0x"), F.lower(F.hex(o.o_orderpriority)))
        ),
        "gas_limit": o.o_custkey + 8000000,
        "gas_used": F.floor(o.o_totalprice / 10),
        "timestamp": _epoch(o.o_orderdate),
        "transaction_count": F.floor(o.o_totalprice / 100000),
        "base_fee_per_gas": F.lit(None),
    }
    return o.select(*[cols[name].cast("string").alias(name) for name in BLOCK_FIELDS])


def blocks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as the headed-CSV reader would give them (for Q9/Q10)."""
    return block_columns(load_table(spark, sf_dir, "orders"))


def block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw block lines: header, one per order, 18-field and bad-size lines."""
    header = spark.range(1).select(F.lit(",".join(BLOCK_FIELDS)).alias("value"))
    blocks = blocks_table(spark, sf_dir)
    valid = blocks.select(_line([F.col(c) for c in BLOCK_FIELDS]))
    cu = load_table(spark, sf_dir, "customer")
    short = cu.select(
        _line([cu.c_custkey, F.concat(F.lit("0xh"), cu.c_custkey)] + [F.lit("x")] * (len(BLOCK_FIELDS) - 3))
    )
    pa = load_table(spark, sf_dir, "part")
    bad_size = pa.select(
        _line(
            [
                F.lit("n/a") if name == "size" else F.concat(F.lit("0xq"), pa.p_partkey)
                for name in BLOCK_FIELDS
            ]
        )
    )
    return header.unionByName(valid).unionByName(short).unionByName(bad_size)


def scam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scams.json as one document per line, one entry per supplier.

    Entry fields follow the public list format: ``id`` (number), ``name``,
    ``url``, ``coin``, ``category``, optional ``subcategory``, ``addresses``
    (the supplier's own address and the next supplier's) and ``status``
    (JSON null for low balances).  Suppliers with a negative balance get a
    comma in their name, region entries get a non-numeric id; both kinds are
    dropped by the reader's rules.
    """
    su = load_table(spark, sf_dir, "supplier")
    na = load_table(spark, sf_dir, "nation")
    re = load_table(spark, sf_dir, "region")
    s = su.join(na, su.s_nationkey == na.n_nationkey).join(re, F.col("n_regionkey") == re.r_regionkey)
    common = [
        F.col("s_nationkey").alias("id"),
        F.when(F.col("s_acctbal") < 0, F.concat(F.col("n_name"), F.lit(", Ltd")))
        .otherwise(F.col("n_name"))
        .alias("name"),
        F.concat(F.lit("https://scam.example/"), F.col("s_suppkey")).alias("url"),
        F.lit("ETH").alias("coin"),
        F.when(F.col("r_name") == "AMERICA", F.lit("Scam")).otherwise(F.col("r_name")).alias("category"),
    ]
    tail = [
        F.array(_addr(F.col("s_suppkey")), _addr(F.col("s_suppkey") + 1)).alias("addresses"),
        F.when(F.col("s_acctbal") >= 1000, F.lit("Active")).alias("status"),
    ]
    keep_nulls = {"ignoreNullFields": "false"}
    with_sub = F.to_json(F.struct(*common, F.col("n_name").alias("subcategory"), *tail), keep_nulls)
    without_sub = F.to_json(F.struct(*common, *tail), keep_nulls)
    entry = F.when(F.col("s_acctbal") > 5000, with_sub).otherwise(without_sub)
    supplier_docs = s.select(_doc(_addr(F.col("s_suppkey")), entry))

    region_entry = F.to_json(
        F.struct(
            F.concat(F.lit("r"), re.r_regionkey).alias("id"),
            re.r_name.alias("name"),
            F.lit("https://scam.example/r").alias("url"),
            F.lit("ETH").alias("coin"),
            F.lit("Phishing").alias("category"),
            F.array(_addr(re.r_regionkey)).alias("addresses"),
            F.lit("Offline").alias("status"),
        )
    )
    region_docs = re.select(_doc(F.concat(F.lit("0xr"), re.r_regionkey), region_entry))
    return supplier_docs.unionByName(region_docs)


def scam_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scams.json as one document on one line: texts to be written one after the other, with blanks between."""
    entry = F.regexp_extract("value", r'(?s)^\{"success": true, "result": \{(.*)\}\}$', 1)
    entries = scam_lines(spark, sf_dir).select(F.lit(1).alias("at"), F.concat(entry, F.lit(",")).alias("value"))
    # an entry that the reader's rules drop, so that every comma stands before one
    last = '"0xnone": {"id": "", "name": "", "url": "", "coin": "", "category": "", "addresses": [], "status": ""}}, "total": 0}'
    ends = spark.createDataFrame([(0, '{"success": true, "result": {'), (2, last)], "at int, value string")
    return entries.unionByName(ends).coalesce(1).sortWithinPartitions("at").select("value")


def _doc(key: Column, entry_json: Column) -> Column:
    return F.concat(
        F.lit('{"success": true, "result": {"'), key, F.lit('": '), entry_json, F.lit("}}")
    ).alias("value")


#: Digits behind the varying front of the wide files' whole numbers.
WIDE_VALUE_DIGITS, WIDE_SIZE_DIGITS = 52, 40


def wide_transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per ``lineitem`` row: values of about 60 digits, gas and gas prices with fractions."""
    li = load_table(spark, sf_dir, "lineitem")
    return li.select(
        _line(
            _tx_fields(
                hash=F.concat(F.lit("0xw"), li.l_orderkey, F.lit("_"), li.l_linenumber),
                block_number=li.l_orderkey,
                to_address=_addr(li.l_suppkey),
                value=F.concat(
                    F.round(li.l_extendedprice * 100).cast("bigint"), F.lpad(li.l_partkey.cast("string"), WIDE_VALUE_DIGITS, "0")
                ),
                gas=F.concat(li.l_quantity.cast("bigint") * 1000, F.lit("."), F.lpad((li.l_linenumber * 7).cast("string"), 3, "0")),
                gas_price=F.concat(li.l_partkey, F.lit("."), F.lpad((li.l_linenumber * 1237).cast("string"), 5, "0")),
                block_timestamp=_epoch(li.l_shipdate),
            )
        )
    )


def wide_block_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order, with block sizes of about 48 digits."""
    blocks = load_table(spark, sf_dir, "orders")
    size = F.concat(
        F.floor(blocks.o_totalprice * 100).cast("string"), F.lpad(blocks.o_orderkey.cast("string"), WIDE_SIZE_DIGITS, "0")
    )
    miner = F.concat(F.lit("0xm"), blocks.o_custkey)
    given = {"number": blocks.o_orderkey, "hash": F.concat(F.lit("0xw"), blocks.o_orderkey), "miner": miner, "size": size}
    return blocks.select(_line([given.get(name, F.lit("")) for name in BLOCK_FIELDS]))


#: Lines of a compressed file: gzip files are not split, so a task reads whole ones.
LINES_PER_FILE = 250_000
LEDGER_FILES = ("transactions", "contracts", "blocks", "blocks_csv", "scams", "scams_document", "wide_transactions", "wide_blocks")


def write_ledger_file(spark: SparkSession, sf_dir: str, name: str, path: str, compressed: bool = False) -> None:
    """Write one derived ledger input as files, the form real jobs read.

    ``transactions``, ``contracts``, ``blocks``: text lines; ``blocks_csv``:
    headed CSV of the valid blocks (the storage profile's input);
    ``scams``: one JSON document per line; ``scams_document``: one document on
    one line; ``wide_transactions`` and ``wide_blocks``: lines with very long
    and fractional numbers.  ``compressed``: gzip files of at most
    :data:`LINES_PER_FILE` lines (not the one document, whose reader takes
    byte ranges of plain text).
    """
    if name == "scams_document":
        scam_document(spark, sf_dir).write.mode("overwrite").option("lineSep", " ").text(path)
        return
    lines = {
        "transactions": transaction_lines,
        "contracts": contract_lines,
        "blocks": block_lines,
        "blocks_csv": blocks_table,
        "scams": scam_lines,
        "wide_transactions": wide_transaction_lines,
        "wide_blocks": wide_block_lines,
    }[name](spark, sf_dir)
    writer = lines.write.mode("overwrite")
    if compressed:
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE)
    if name == "blocks_csv":
        writer.option("header", "true").csv(path)
    else:
        writer.text(path)


def write_ledger_files(spark: SparkSession, sf_dir: str, out_dir: str) -> dict[str, str]:
    """Write all of :data:`LEDGER_FILES` below ``out_dir`` in plain text and return their paths."""
    paths = {name: f"{out_dir}/{name}" for name in LEDGER_FILES}
    for name, path in paths.items():
        write_ledger_file(spark, sf_dir, name, path)
    return paths


class LedgerFiles(dict):
    """Paths of the ledger files made from one table folder, each written when it is first asked for.

    A query so writes the inputs that it reads and no others.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, out_dir: str):
        super().__init__()
        self._made_from, self._out_dir = (spark, sf_dir), out_dir

    def __missing__(self, name: str) -> str:
        # a path of its own, should two threads ask for the same file at once
        path = f"{self._out_dir}/{name}-{uuid.uuid4().hex}"
        write_ledger_file(*self._made_from, name, path, compressed=True)
        self[name] = path
        return path
