"""Field layouts of the ledger files and result schemas.

The reference addresses fields by position only; names follow the public
export layout of this ledger.  Fixed values: these lists must keep their
order, as positions are what the rules of each query refer to.
"""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# Transactions.csv, 15 fields, in file order.
TRANSACTION_FIELDS = (
    "hash",
    "nonce",
    "block_hash",
    "block_number",
    "transaction_index",
    "from_address",
    "to_address",
    "value",
    "gas",
    "gas_price",
    "input",
    "block_timestamp",
    "max_fee_per_gas",
    "max_priority_fee_per_gas",
    "transaction_type",
)

# Contracts.csv, 6 fields, in file order.
CONTRACT_FIELDS = (
    "address",
    "bytecode",
    "function_sighashes",
    "is_erc20",
    "is_erc721",
    "block_number",
)

# Blocks.csv, 19 fields, in file order.
BLOCK_FIELDS = (
    "number",
    "hash",
    "parent_hash",
    "nonce",
    "sha3_uncles",
    "logs_bloom",
    "transactions_root",
    "state_root",
    "receipts_root",
    "miner",
    "difficulty",
    "total_difficulty",
    "size",
    "extra_data",
    "gas_limit",
    "gas_used",
    "timestamp",
    "transaction_count",
    "base_fee_per_gas",
)

# The five hex columns whose removal Q9 prices.
HEX_OVERHEAD_COLUMNS = (
    "logs_bloom",
    "sha3_uncles",
    "transactions_root",
    "state_root",
    "receipts_root",
)

# Keys of one scam entry in scams.json, in the order the
# reference joins them into its eight-field text row.
SCAM_FIELDS = ("id", "name", "url", "coin", "category", "subcategory", "address", "status")


# Rules and constants the results depend on, as the reference
# applies them.
#   header marker of blocks.csv: field "hash" equals "hash"
#   category recode of scams:    "Scam" -> "Scamming"
#   hex text storage:            bytes per row = (mean length - 2) * 4 / 8
#                                ("0x" prefix, four bits per hex character)
#   month key text:              "MM/YYYY" of the UTC month
#   result sizes:                top 10 services, top 10 miners, top 15 scams
#   yearly panels drop:          2019 (the last, partial year)
BLOCK_HEADER_MARKER = "hash"
SCAM_RECODE = ("Scam", "Scamming")
HEX_PREFIX_CHARS = 2
HEX_BITS_PER_CHAR = 4
MONTH_TEXT_FORMAT = "MM/yyyy"
TOP_SERVICES = 10
TOP_MINERS = 10
TOP_SCAMS = 15
PANEL_DROP_YEARS = (2019,)


def field_index(layout: tuple[str, ...], name: str) -> int:
    return layout.index(name)


def all_string_schema(names: tuple[str, ...]) -> StructType:
    """Schema for reading a headed CSV without an inference pass."""
    return StructType([StructField(n, StringType(), True) for n in names])
