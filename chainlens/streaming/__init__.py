"""Structured Streaming: Q1/Q2 kept current over an arriving folder of files."""

from chainlens.streaming.incremental import (
    monthly_time_analysis,
    read_monthly_time_analysis,
    read_transaction_stream,
    start_monthly_time_analysis,
)

__all__ = [
    "monthly_time_analysis",
    "read_monthly_time_analysis",
    "read_transaction_stream",
    "start_monthly_time_analysis",
]
