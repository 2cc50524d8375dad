"""Every query as ``(spark, sf_dir) -> DataFrame`` over the driver's tables.

The ledger inputs are derived from the star-schema Parquet tables by
:mod:`chainlens.sources.star`, written as ledger files and read by the same
readers that read real ones, so each entry runs the full production path on
data that grows with the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.operators import profile
from chainlens.operators.stored import stored_path
from chainlens.plans import queries as Q
from chainlens.plans import reports as R
from chainlens.session import ensure_checkpoint_dir
from chainlens.sinks.results import read_long_json_array, write_scam_months
from chainlens.sources import star
from chainlens.sources.ledger import (
    parse_blocks,
    parse_contracts,
    parse_transactions,
    read_blocks,
    read_blocks_table,
    read_contracts,
    read_transactions,
    rule_counts,
)
from chainlens.sources.scam_list import parse_scams, read_long_scams, read_scams
from chainlens.sources.staging import read_staged

# The view's last calendar year is partial, like 2019 in the reference.
STAR_PANEL_DROP = (2001,)


class LedgerInputs:
    """Parsed ledger frames for one table folder (built lazily, once)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def tx(self) -> DataFrame:
        return parse_transactions(star.transaction_lines(self.spark, self.sf_dir))

    @cached_property
    def contracts(self) -> DataFrame:
        return parse_contracts(star.contract_lines(self.spark, self.sf_dir))

    @cached_property
    def blocks(self) -> DataFrame:
        return parse_blocks(star.block_lines(self.spark, self.sf_dir))

    @cached_property
    def blocks_table(self) -> DataFrame:
        return star.blocks_table(self.spark, self.sf_dir)

    @cached_property
    def scams(self) -> DataFrame:
        return parse_scams(star.scam_lines(self.spark, self.sf_dir))

    has_wide = True

    @cached_property
    def long_scams(self) -> DataFrame:
        return self.scams  # a long document needs a file

    @cached_property
    def wide_tx(self) -> DataFrame:
        return parse_transactions(star.wide_transaction_lines(self.spark, self.sf_dir))

    @cached_property
    def wide_blocks(self) -> DataFrame:
        return parse_blocks(star.wide_block_lines(self.spark, self.sf_dir))


class FileInputs:
    """Parsed ledger frames read from files (see ``star.write_ledger_files``)."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths = spark, paths

    @cached_property
    def tx(self) -> DataFrame:
        return read_transactions(self.spark, self.paths["transactions"])

    @cached_property
    def contracts(self) -> DataFrame:
        return read_contracts(self.spark, self.paths["contracts"])

    @cached_property
    def blocks(self) -> DataFrame:
        return read_blocks(self.spark, self.paths["blocks"])

    @cached_property
    def blocks_table(self) -> DataFrame:
        return read_blocks_table(self.spark, self.paths["blocks_csv"])

    @cached_property
    def scams(self) -> DataFrame:
        return read_scams(self.spark, self.paths["scams"])

    @cached_property
    def long_scams(self) -> DataFrame:
        return read_long_scams(self.spark, self.paths["scams_document"])

    @property
    def has_wide(self) -> bool:
        return "wide_transactions" in self.paths and "scams_document" in self.paths

    @cached_property
    def wide_tx(self) -> DataFrame:
        return read_transactions(self.spark, self.paths["wide_transactions"])

    @cached_property
    def wide_blocks(self) -> DataFrame:
        return read_blocks(self.spark, self.paths["wide_blocks"])


class TableInputs(FileInputs):
    """Like :class:`FileInputs`, over files made from one table folder, each when it is first read."""

    has_wide = True

    def __init__(self, spark: SparkSession, sf_dir: str, folder: str):
        super().__init__(spark, star.LedgerFiles(spark, sf_dir, folder))


class StagedInputs(FileInputs):
    """Like :class:`FileInputs`, with transactions/contracts/blocks read from
    their staged Parquet form (see :mod:`chainlens.sources.staging`)."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], staged: dict[str, str]):
        super().__init__(spark, paths)
        self.staged = staged

    has_wide = False  # the wide files are not staged

    @cached_property
    def tx(self) -> DataFrame:
        return read_staged(self.spark, self.staged["transactions"])

    @cached_property
    def contracts(self) -> DataFrame:
        return read_staged(self.spark, self.staged["contracts"])

    @cached_property
    def blocks(self) -> DataFrame:
        return read_staged(self.spark, self.staged["blocks"])


def _array_round_trip(by_month: DataFrame) -> DataFrame:
    """Q6 as the reference stores it - one JSON array, here in many parts - and read back."""
    path = stored_path(by_month.sparkSession, "ether-against-time")
    write_scam_months(by_month, path)
    return R.scam_months_from_rows(read_long_json_array(by_month.sparkSession, path))


def build(inputs: LedgerInputs | FileInputs) -> dict[str, Callable[[], DataFrame]]:
    i = inputs
    q = {
        "q1_monthly_count": lambda: Q.monthly_transaction_count(i.tx),
        "q2_monthly_avg_value": lambda: Q.monthly_average_value(i.tx),
        "q3_top_services": lambda: Q.top_services(i.tx, i.contracts),
        "q4_top_miners": lambda: Q.top_miners(i.blocks),
        "q5_top_scams": lambda: Q.top_scams(i.tx, i.scams),
        "q6_scam_by_month": lambda: Q.scam_value_by_month(i.tx, i.scams),
        "q6_by_ether": lambda: R.scam_months_by_ether(Q.scam_value_by_month(i.tx, i.scams)),
        "q6_array_round_trip": lambda: _array_round_trip(Q.scam_value_by_month(i.tx, i.scams)),
        "q7_monthly_gas_price": lambda: Q.monthly_gas_price(i.tx),
        "q8_contract_gas": lambda: Q.monthly_contract_gas(i.tx, i.contracts),
        "q9_column_space": lambda: profile.column_space(i.blocks_table),
        "q10_space_share": lambda: profile.column_space_share(i.blocks_table),
        "q11_count_grid": lambda: R.count_grid(Q.monthly_transaction_count(i.tx)),
        "q12_avg_grid": lambda: R.average_grid(Q.monthly_average_value(i.tx)),
        "q13_ranked_services": lambda: R.ranked_services(Q.top_services(i.tx, i.contracts)),
        "q14_ranked_miners": lambda: R.ranked_miners(Q.top_miners(i.blocks)),
        "q15_scam_table": lambda: R.scam_table(Q.top_scams(i.tx, i.scams)),
        "q16_scam_pivot": lambda: R.scam_pivot_exact(Q.scam_month_base(i.tx, i.scams)),
        "q17_gas_price_panels": lambda: R.gas_price_panels(Q.monthly_gas_price(i.tx), STAR_PANEL_DROP),
        "q18_gas_panels": lambda: R.gas_panels(Q.monthly_contract_gas(i.tx, i.contracts), STAR_PANEL_DROP),
        "rules_transactions": lambda: rule_counts(
            i.tx, "block_ok", "value_ok", "gas_price_ok", "ts_digits", "ts_numeric"
        ),
        "rules_contracts": lambda: rule_counts(i.contracts, "well_formed"),
        "rules_blocks": lambda: rule_counts(
            i.blocks.withColumn("size_ok", F.coalesce("size_ok", F.lit(False))), "well_formed", "size_ok"
        ),
        "scam_rows": lambda: i.scams,
        # lists over the limit of a broadcast: a Bloom filter where transactions are read, then a shuffle join
        "q3_large_list": lambda: Q.top_services(i.tx, i.contracts, max_broadcast_bytes=0),
        "q5_large_list": lambda: Q.top_scams(i.tx, i.scams, max_broadcast_bytes=0),
        "q6_large_list": lambda: Q.scam_value_by_month(i.tx, i.scams, max_broadcast_bytes=0),
        "q8_large_list": lambda: Q.monthly_contract_gas(i.tx, i.contracts, max_broadcast_bytes=0),
    }
    if i.has_wide:
        q |= {
            "scam_rows_one_document": lambda: i.long_scams,
            "q5_one_document": lambda: Q.top_scams(i.tx, i.long_scams),
            "q2_long_values": lambda: Q.monthly_average_value(i.wide_tx),
            "q3_long_values": lambda: Q.service_totals(i.wide_tx, i.contracts),
            "q4_long_sizes": lambda: Q.miner_totals(i.wide_blocks),
            "q7_fractions": lambda: Q.monthly_gas_price(i.wide_tx),
            "q8_fractions": lambda: Q.monthly_contract_gas(i.wide_tx, i.contracts),
        }
    return q


QUERY_NAMES = tuple(build(LedgerInputs(None, "")).keys())  # type: ignore[arg-type]


_INPUTS: dict[tuple[str, str], FileInputs] = {}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build query ``name`` over the ledger files made from ``sf_dir``.

    The files that the query reads are written, compressed, to the shared
    checkpoint folder once per application and read by the readers that read
    real ledger files.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INPUTS:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
        _INPUTS[key] = TableInputs(spark, sf_dir, folder)
    return build(_INPUTS[key])[name]()
