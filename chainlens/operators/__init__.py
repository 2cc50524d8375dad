"""Reusable DataFrame operators: exact sums, checked broadcasts, top-k, profile, calendar reshapes."""

from chainlens.operators.calendar_grid import category_pivot, year_month_grid, yearly_panels
from chainlens.operators.join import broadcast_if_small, byte_size, multiplicity
from chainlens.operators.profile import column_space, column_space_from_share, column_space_share
from chainlens.operators.topk import ranked, top_k

__all__ = [
    "broadcast_if_small",
    "category_pivot",
    "column_space",
    "column_space_from_share",
    "column_space_share",
    "byte_size",
    "multiplicity",
    "ranked",
    "top_k",
    "year_month_grid",
    "yearly_panels",
]
