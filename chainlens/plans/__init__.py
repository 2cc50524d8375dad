"""The questions: Q1-Q8 (queries), Q11-Q18 (reports); Q9/Q10 live in operators.profile."""

from chainlens.plans.queries import (
    monthly_average_value,
    monthly_contract_gas,
    monthly_gas_price,
    monthly_transaction_count,
    scam_month_base,
    scam_value_by_month,
    top_miners,
    top_scams,
    top_services,
)
from chainlens.plans.reports import (
    average_grid,
    count_grid,
    gas_panels,
    gas_price_panels,
    ranked_miners,
    ranked_services,
    scam_pivot,
    scam_pivot_exact,
    scam_table,
)

__all__ = [
    "average_grid",
    "count_grid",
    "gas_panels",
    "gas_price_panels",
    "monthly_average_value",
    "monthly_contract_gas",
    "monthly_gas_price",
    "monthly_transaction_count",
    "ranked_miners",
    "ranked_services",
    "scam_month_base",
    "scam_pivot",
    "scam_pivot_exact",
    "scam_table",
    "scam_value_by_month",
    "top_miners",
    "top_scams",
    "top_services",
]
