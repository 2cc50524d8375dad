"""Column-level building blocks (no Python UDFs)."""

from chainlens.functions.calendar import (
    epoch_seconds,
    month_abbrev,
    month_start,
    month_text,
    parse_month_text,
)
from chainlens.functions.parse import (
    field,
    integer_limbs,
    is_digits,
    is_integer_literal,
    is_numeric_like,
    number_parts,
    split_fields,
)

__all__ = [
    "epoch_seconds",
    "field",
    "integer_limbs",
    "is_digits",
    "is_integer_literal",
    "is_numeric_like",
    "month_abbrev",
    "month_start",
    "month_text",
    "number_parts",
    "parse_month_text",
    "split_fields",
]
