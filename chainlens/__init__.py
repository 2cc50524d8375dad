"""chainlens: ledger analytics expressed as Spark DataFrame plans.

Raw, partly malformed comma-separated ledger lines (transactions, contracts,
blocks) and a JSON list of reported scams are parsed into typed DataFrames
with one guard flag per validity rule; the queries in :mod:`chainlens.plans`
apply exactly the guards each question needs and leave planning to Catalyst.
"""

from chainlens.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
__version__ = "0.1.0"
