"""Result writers and readers: JSON arrays of one line and of any size, JSON lines, CSV."""

from chainlens.sinks.results import (
    json_array,
    json_text,
    parse_json_array,
    read_json_array,
    read_long_json_array,
    run_stamp,
    write_csv,
    write_json_array,
    write_long_json_array,
    write_rows_json,
    write_scam_months,
)

__all__ = [
    "json_array",
    "json_text",
    "parse_json_array",
    "read_json_array",
    "read_long_json_array",
    "run_stamp",
    "write_csv",
    "write_json_array",
    "write_long_json_array",
    "write_rows_json",
    "write_scam_months",
]
