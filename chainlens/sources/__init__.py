"""Readers: ledger text lines, headed CSV, scams JSON, staged Parquet."""

from chainlens.sources.ledger import (
    keep_valid,
    parse_blocks,
    parse_contracts,
    parse_transactions,
    read_blocks,
    read_blocks_table,
    read_contracts,
    read_lines,
    read_transactions,
    rule_counts,
)
from chainlens.sources.scam_list import parse_scams, read_long_scams, read_scams
from chainlens.sources.staging import read_staged, stage, stage_ledger

__all__ = [
    "keep_valid",
    "parse_blocks",
    "parse_contracts",
    "parse_scams",
    "parse_transactions",
    "read_blocks",
    "read_blocks_table",
    "read_contracts",
    "read_lines",
    "read_long_scams",
    "read_scams",
    "read_staged",
    "read_transactions",
    "rule_counts",
    "stage",
    "stage_ledger",
]
