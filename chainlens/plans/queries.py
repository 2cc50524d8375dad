"""The ledger questions Q1-Q8 as DataFrame plans.

Inputs are the typed frames of :mod:`chainlens.sources.ledger` /
:mod:`chainlens.sources.scam_list`; each query applies its own rule set (the
populations differ on purpose, as in the reference) and returns a small
result DataFrame.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.functions.calendar import month_text
from chainlens.functions.parse import MAX_DIGITS, WEI
from chainlens.operators.aggregate import integer_order, integer_sums, integer_total, number_mean, number_total, part_sums
from chainlens.operators.bloom import maybe_listed
from chainlens.operators.join import broadcast_if_small, multiplicity
from chainlens.operators.stored import stored
from chainlens.operators.topk import top_k
from chainlens.schema import TOP_MINERS, TOP_SCAMS, TOP_SERVICES
from chainlens.sources.ledger import integer_value, keep_valid
from chainlens.sources.scam_list import scam_addresses


def _monthly(agg: DataFrame, *cols) -> DataFrame:
    """Render the month DATE as 'MM/YYYY'.

    Row order is left open, as in the reference (its result is "any 100"
    rows of an unordered aggregate); the JSON-array sink and the reports
    impose an order on the small result without a global sort here.
    """
    return agg.select(month_text(F.col("month")).alias("month"), *cols)


def _text_ordered(agg: DataFrame, *cols) -> DataFrame:
    """Render the month and order by its *text*, as the reference's sortByKey
    ('01/2016' < '01/2017' < '02/2016').  The result has one row per month,
    so the global sort moves a few hundred rows."""
    return agg.select(month_text(F.col("month")).alias("month"), *cols).orderBy("month")


def monthly_base(tx: DataFrame, on_bad: str = "drop") -> DataFrame:
    """Per month DATE: Q1's count and the parts of Q2's mean, in one aggregate.

    Q1's rows (block time digits) are a superset of Q2's (also a numeric-like
    value), so Q2's sums are conditional; what a caller does not select is not
    computed.
    """
    valid = keep_valid(tx, F.col("ts_digits"), F.col("block_timestamp").isNotNull(), on_bad, "block_timestamp")
    return valid.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("value_ok").alias("n_value"),
        *part_sums("value", only="value_ok"),
    )


def counts_from_base(base: DataFrame) -> DataFrame:
    return _monthly(base, "n")


def averages_from_base(base: DataFrame) -> DataFrame:
    return _monthly(base.where(F.col("n_value") > 0), number_mean("value", "n_value").alias("avg_value"))


def monthly_transaction_count(tx: DataFrame, on_bad: str = "drop") -> DataFrame:
    """Q1: transactions per UTC month -> (month, n)."""
    return counts_from_base(monthly_base(tx, on_bad))


def monthly_average_value(tx: DataFrame, on_bad: str = "drop") -> DataFrame:
    """Q2: mean value per UTC month -> (month, avg_value DOUBLE)."""
    return averages_from_base(monthly_base(tx.where("value_ok"), on_bad))


def _joined_side(side: DataFrame, rows: DataFrame, key: str, max_broadcast_bytes: int | None) -> tuple[DataFrame, DataFrame, bool]:
    """A list of addresses and the rows that may meet it: ``(side, rows, small)``.

    A list proven small is broadcast.  A larger one is stored once, and rows
    whose address its Bloom filter excludes are dropped where they are read,
    before anything is summed or shuffled.
    """
    hinted, small = broadcast_if_small(side, max_broadcast_bytes)
    if small:
        return hinted, rows, True
    kept = stored(side, "listed")
    return kept, maybe_listed(rows, key, kept, "address"), False


def service_totals(
    tx: DataFrame,
    contracts: DataFrame,
    k: int = TOP_SERVICES,
    distinct_contracts: bool = False,
    on_bad: str = "drop",
    max_broadcast_bytes: int | None = None,
) -> DataFrame:
    """Q3 with sums of any length: contracts that received most value -> (address, value as decimal text).

    A contract listed ``c`` times appears ``c`` times with the same total (the
    reference's fan-out); ``distinct_contracts=True`` counts every listed
    address once.  The list is reduced to (address, copies).  If that is
    proven small it is broadcast, and transactions to other addresses are
    dropped where they are read, before the sums are shuffled.  A larger list
    drops what its Bloom filter excludes there; the values that are left are
    summed per receiving address, and the sums join the list.  The fan-out is
    applied after the ranking: the ``k`` best addresses are taken, and only
    they are repeated (at most ``k`` times each) before the final top ``k``.
    """
    valid = keep_valid(tx, F.col("block_ok"), F.col("value_wei_ok"), on_bad, "value")
    copies = multiplicity(contracts.where("well_formed").select("address"), "address")
    if distinct_contracts:
        copies = copies.select("address", F.lit(1).cast("bigint").alias("copies"))
    side, valid, small = _joined_side(copies, valid, "to_address", max_broadcast_bytes)
    if small:
        joined = valid.join(side, valid["to_address"] == side["address"])
        sums = integer_sums(joined, integer_value("value"), "address", "copies")
    else:
        received = valid.withColumn("receiver", F.col("to_address"))
        sums = integer_sums(received, integer_value("value"), "receiver").join(side, F.col("receiver") == side["address"])
    totals = sums.select("address", "copies", integer_total("limbs").alias("value"))
    best = top_k(totals.withColumn("_order", integer_order(F.col("value"))), k, "_order", "address")
    repeats = F.array_repeat(F.lit(0), F.least(F.col("copies"), F.lit(k)).cast("int"))
    expanded = best.select("address", "value", "_order", F.explode(repeats).alias("_copy"))
    return top_k(expanded, k, "_order", "address").select("address", "value")


def _as_decimal(totals: DataFrame, name: str) -> DataFrame:
    """Totals as DECIMAL(38,0); an error, never a loss, where one has no such form."""
    message = F.lit(f"a sum of {name} has more than {MAX_DIGITS} digits; it does not fit DECIMAL({MAX_DIGITS}, 0)")
    value = F.col(name).try_cast(WEI)
    return totals.withColumn(name, F.when(value.isNull(), F.raise_error(message).cast(WEI)).otherwise(value))


def top_services(
    tx: DataFrame,
    contracts: DataFrame,
    k: int = TOP_SERVICES,
    distinct_contracts: bool = False,
    on_bad: str = "drop",
    max_broadcast_bytes: int | None = None,
) -> DataFrame:
    """Q3: :func:`service_totals` -> (address, value DECIMAL(38,0)); a listed sum beyond 38 digits is an error."""
    return _as_decimal(service_totals(tx, contracts, k, distinct_contracts, on_bad, max_broadcast_bytes), "value")


def miner_totals(blocks: DataFrame, k: int = TOP_MINERS, on_bad: str = "drop") -> DataFrame:
    """Q4 with sums of any length: miners with the largest total block size -> (miner, size as decimal text)."""
    valid = keep_valid(blocks, F.col("well_formed"), F.col("size_ok"), on_bad, "size")
    sums = integer_sums(valid, integer_value("size"), "miner")
    totals = sums.select("miner", integer_total("limbs").alias("size"))
    return top_k(totals.withColumn("_order", integer_order(F.col("size"))), k, "_order", "miner").select("miner", "size")


def top_miners(blocks: DataFrame, k: int = TOP_MINERS, on_bad: str = "drop") -> DataFrame:
    """Q4: :func:`miner_totals` -> (miner, size DECIMAL(38,0)); a listed sum beyond 38 digits is an error."""
    return _as_decimal(miner_totals(blocks, k, on_bad), "size")


def _scam_sums(tx: DataFrame, scams: DataFrame, keys: list[str], on_bad: str, max_broadcast_bytes: int | None) -> DataFrame:
    """Exact value sums of transactions to scams by ``keys`` of (month, id, category).

    A list proven small is broadcast once: other transactions are dropped
    where they are read, and one partial and final aggregate follows.  A
    larger list drops what its Bloom filter excludes there; transactions are
    then summed per (address, month), so that a hot address is one row per
    task, and the sums meet the list in a shuffle join.  An address listed
    under several scams counts for each.
    """
    valid = keep_valid(tx, F.col("value_ok"), F.lit(True), on_bad, "value")
    side, valid, small = _joined_side(scam_addresses(scams), valid, "to_address", max_broadcast_bytes)
    if not small:
        valid = valid.groupBy("to_address", "month").agg(*part_sums("value"))
    joined = valid.join(side, valid["to_address"] == side["address"])
    return joined.groupBy(*keys).agg(*part_sums("value", "ether"))


def scam_month_base(
    tx: DataFrame, scams: DataFrame, on_bad: str = "drop", max_broadcast_bytes: int | None = None
) -> DataFrame:
    """Exact value sums per (month, id, category) of transactions to scams.

    ``month`` is NULL for rows whose block time is not an integer: Q5
    counts them, Q6 does not.
    """
    return _scam_sums(tx, scams, ["month", "id", "category"], on_bad, max_broadcast_bytes)


def top_scams_from_base(base: DataFrame, k: int = TOP_SCAMS) -> DataFrame:
    totals = base.groupBy("id", "category").agg(*part_sums("ether"))
    return top_k(totals.select("id", "category", number_total("ether").alias("ether")), k, "ether", "id", "category")


def scam_by_month_from_base(base: DataFrame) -> DataFrame:
    rows = base.where(F.col("month").isNotNull())
    return rows.select(
        month_text(F.col("month")).alias("month"), "id", "category", number_total("ether").alias("ether")
    )


def top_scams(
    tx: DataFrame, scams: DataFrame, k: int = TOP_SCAMS, on_bad: str = "drop", max_broadcast_bytes: int | None = None
) -> DataFrame:
    """Q5: most lucrative scams -> (id, category, ether DOUBLE)."""
    totals = _scam_sums(tx, scams, ["id", "category"], on_bad, max_broadcast_bytes)
    return top_k(totals.select("id", "category", number_total("ether").alias("ether")), k, "ether", "id", "category")


def scam_value_by_month(
    tx: DataFrame, scams: DataFrame, on_bad: str = "drop", max_broadcast_bytes: int | None = None
) -> DataFrame:
    """Q6: value per month and scam -> (month, id, category, ether DOUBLE)."""
    if on_bad == "fail":
        tx = keep_valid(tx, F.col("value_ok"), F.col("block_timestamp").isNotNull(), on_bad, "block_timestamp")
    return scam_by_month_from_base(scam_month_base(tx, scams, on_bad, max_broadcast_bytes))


def _gas_rows(tx: DataFrame, on_bad: str, need_gas: bool) -> DataFrame:
    converted = F.col("block_timestamp").isNotNull()
    if need_gas:
        converted = converted & F.col("gas_parsed")
    return keep_valid(
        tx, F.col("gas_price_ok") & F.col("ts_numeric"), converted, on_bad, "block_timestamp/gas"
    )


def monthly_gas_price(tx: DataFrame, on_bad: str = "drop") -> DataFrame:
    """Q7: mean gas price per month, ordered by month *text* -> (month, avg_gas_price)."""
    agg = _gas_rows(tx, on_bad, need_gas=False).groupBy("month").agg(
        *part_sums("gas_price"), F.count(F.lit(1)).alias("n")
    )
    return _text_ordered(agg, number_mean("gas_price", "n").alias("avg_gas_price"))


def monthly_contract_gas(
    tx: DataFrame, contracts: DataFrame, on_bad: str = "drop", max_broadcast_bytes: int | None = None
) -> DataFrame:
    """Q8: mean gas of transactions to contracts per month -> (month, avg_gas).

    Row-level join semantics: a contract listed ``c`` times weighs its
    transactions ``c`` times.  The contract list is reduced to
    (address, copies), so the join is one to one and the weight multiplies
    partial sums.  If that list is proven small it is broadcast and the
    transactions are joined where they are read.  Otherwise those that the
    list's Bloom filter lets through are first pre-aggregated per (address,
    month) - which also defuses a hot address - and only those partial sums
    are shuffled to the join.
    """
    rows = _gas_rows(tx, on_bad, need_gas=True)
    listed = contracts.where("well_formed").select("address")
    copies = multiplicity(listed, "address")
    side, rows, small = _joined_side(copies, rows, "to_address", max_broadcast_bytes)
    if small:
        # Sum per (month, copies) first: the weight multiplies a handful of
        # partial sums instead of every row's DECIMAL value.
        joined = rows.join(side, rows["to_address"] == side["address"]).groupBy("month", "copies")
        weighed = joined.agg(*part_sums("gas"), F.count(F.lit(1)).alias("c"))
    else:
        per_address = rows.groupBy("to_address", "month").agg(*part_sums("gas"), F.count(F.lit(1)).alias("c"))
        weighed = per_address.join(side, per_address["to_address"] == side["address"])
    agg = weighed.groupBy("month").agg(
        *part_sums("gas", times="copies"), F.sum(F.col("c") * F.col("copies")).alias("n")
    )
    return _text_ordered(agg, number_mean("gas", "n").alias("avg_gas"))
