"""

``queries()`` maps every implemented question/operator to a callable
``(spark, sf_dir) -> DataFrame`` that derives ledger inputs from the
driver's tables (see ``chainlens.sources.star``) and runs the same plan a
user runs on ledger files.  ``oracle_sql()`` gives, per query, DuckDB SQL
over the raw tables that computes the expected result independently: it
rebuilds the typed ledger rows directly (no text parsing) and applies each
query's rule set as known per derived-row family.

Doubles derived from exact sums are rendered by DuckDB through VARCHAR:
its DECIMAL->DOUBLE cast is not correctly rounded above 2^53, whereas its
text->DOUBLE parse and Spark's DECIMAL->DOUBLE cast are.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from chainlens.plans import catalog  # noqa: E402

try:  # the training-data subpackage and its pipeline may be absent
    import corpus_pipeline
    from chainlens.llm import registry as llm_registry
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "chainlens.llm"):
        raise
    corpus_pipeline = llm_registry = None

SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the ten contracts that received most value (Q3), sf0.001."""
    return catalog.run("q3_top_services", spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: catalog.run(name, spark, sf_dir)

    found = {name: make(name) for name in catalog.QUERY_NAMES}
    if llm_registry is not None:
        found |= llm_registry.QUERIES
        found["pipeline"] = corpus_pipeline.run
    return found


# --------------------------------------------------------------------------
# Oracle SQL (DuckDB).  Fragments mirror chainlens.sources.star.
# --------------------------------------------------------------------------

_DOUBLE = "CAST(CAST({} AS VARCHAR) AS DOUBLE)"


def _dbl(expr: str) -> str:
    return _DOUBLE.format(expr)


def _dec(text_expr: str) -> str:
    return f"CAST({text_expr} AS DECIMAL(38,0))"


_MONTH = "strftime(make_timestamp(ts * 1000000), '%m/%Y')"

# Typed transaction rows per family.  Flags: block_ok (block number digits),
# value_ok (numeric-like), gp_ok (gas price numeric-like), ts_digits,
# ts_numeric; ``value`` is NULL where int() fails, ``ts`` where the block
# time is not an integer.
_TX = f"""
tx AS (
  SELECT TRUE AS block_ok, TRUE AS value_ok, TRUE AS gp_ok, TRUE AS ts_digits, TRUE AS ts_numeric,
         '0xs' || l_suppkey AS to_address,
         {_dec("CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS VARCHAR) || '0000000000000000'")} AS value,
         CAST(l_quantity AS BIGINT) * 1000 AS gas,
         CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS gas_price,
         CAST(epoch(l_shipdate) AS BIGINT) AS ts
  FROM lineitem
  UNION ALL
  SELECT FALSE, TRUE, TRUE, TRUE, TRUE, '0xs' || c_nationkey,
         {_dec("CAST(c_custkey AS VARCHAR) || '0000000000000000'")},
         21000, CAST(c_nationkey + 1 AS BIGINT) * 1000000000, 788918400 + c_custkey * 6007
  FROM customer
  UNION ALL
  SELECT TRUE, FALSE, TRUE, TRUE, TRUE, '0xs' || p_size, NULL,
         p_size + 30000, CAST(p_size AS BIGINT) * 100000000, 820454400 + p_partkey * 3607
  FROM part
  UNION ALL
  SELECT TRUE, TRUE, FALSE, TRUE, TRUE, '0xs' || s_suppkey,
         {_dec("CAST(s_suppkey AS VARCHAR) || '000000000000000'")},
         50000, NULL, 867715200 + s_suppkey * 86400
  FROM supplier
  UNION ALL
  SELECT TRUE, TRUE, TRUE, FALSE, FALSE, '0xs' || n_nationkey,
         {_dec("CAST(n_nationkey + 1 AS VARCHAR) || '000000000000000000'")},
         60000, 1000000000, NULL
  FROM nation
  UNION ALL
  SELECT TRUE, TRUE, TRUE, FALSE, TRUE, '0xs' || r_regionkey,
         {_dec("CAST(r_regionkey + 1 AS VARCHAR) || '00000000000000000000'")},
         70000, 1000000000, NULL
  FROM region
)"""

# The wide files: values of 52 digits behind a price in cents, gas and gas prices with fractions.
_WIDE_TX = """
wide AS (
  SELECT '0xs' || l_suppkey AS to_address,
         CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS front, CAST(l_partkey AS BIGINT) AS back,
         CAST(CAST(l_quantity AS BIGINT) * 1000000 + l_linenumber * 7 AS HUGEINT) AS gas_thousandths,
         CAST(CAST(l_partkey AS BIGINT) * 100000 + l_linenumber * 1237 AS HUGEINT) AS price_parts,
         CAST(epoch(l_shipdate) AS BIGINT) AS ts
  FROM lineitem
)"""


def _wide_total(digits: int) -> str:
    """The exact sum of numbers made of ``front`` and ``digits`` digits that end in ``back``, as text."""
    return f"CAST(SUM(front) AS VARCHAR) || lpad(CAST(SUM(back) AS VARCHAR), {digits}, '0')"


def _scaled_mean(total: str, digits: int) -> str:
    """The DOUBLE of an exact sum of units of 10^-digits, over the rows."""
    text = f"lpad(CAST({total} AS VARCHAR), 40, '0')"
    return f"CAST(left({text}, {40 - digits}) || '.' || right({text}, {digits}) AS DOUBLE) / COUNT(*)"


_CONTRACTS = """
contracts AS (
  SELECT '0xs' || s_suppkey AS address FROM supplier
  UNION ALL SELECT '0xs' || n_nationkey FROM nation
  UNION ALL SELECT 'address'
)"""

_SCAMS = """
scam_base AS (
  SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS VARCHAR) AS id, n_name,
         CASE WHEN r_name = 'AMERICA' THEN 'Scamming' ELSE r_name END AS category
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_acctbal >= 0
),
scams AS (
  SELECT id, category, '0xs' || s_suppkey AS address FROM scam_base
  UNION ALL
  SELECT id, category, '0xs' || (s_suppkey + 1) FROM scam_base
)"""

_BLOCK_COLUMNS = {
    "number": "CAST(o_orderkey AS VARCHAR)",
    "hash": "'0x' || sha256(CAST(o_orderkey AS VARCHAR))",
    "parent_hash": "'0x' || sha256(CAST(o_orderkey - 1 AS VARCHAR))",
    "nonce": "'0x' || lpad(lower(hex(o_custkey)), 16, '0')",
    "sha3_uncles": "'0x' || sha256(o_orderstatus)",
    "logs_bloom": "'0x' || repeat(sha256(o_orderpriority), 8)",
    "transactions_root": "'0x' || sha256('t' || o_orderkey)",
    "state_root": "CASE WHEN o_orderstatus <> 'P' THEN '0x' || sha256('s' || o_orderkey) END",
    "receipts_root": "'0x' || sha256('r' || o_orderkey)",
    "miner": "'0x' || lpad(lower(hex(o_custkey)), 40, '0')",
    "difficulty": "CAST(CAST(floor(o_totalprice) AS BIGINT) * 1000 AS VARCHAR)",
    "total_difficulty": "CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS VARCHAR)",
    "size": "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)",
    "extra_data": "CASE WHEN o_orderpriority <> '5-LOW' THEN '0x' || lower(hex(o_orderpriority)) END",
    "gas_limit": "CAST(o_custkey + 8000000 AS VARCHAR)",
    "gas_used": "CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS VARCHAR)",
    "timestamp": "CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR)",
    "transaction_count": "CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR)",
    "base_fee_per_gas": "CAST(NULL AS VARCHAR)",
}
_HEX_COLUMNS = ("logs_bloom", "sha3_uncles", "transactions_root", "state_root", "receipts_root")


def _blocks_cte() -> str:
    cols = ",\n    ".join(f'{expr} AS "{name}"' for name, expr in _BLOCK_COLUMNS.items())
    return f"blocks AS (\n  SELECT\n    {cols}\n  FROM orders\n)"


def _space_rows(names: list[str], value_name: str, with_share: bool) -> str:
    means = ",\n    ".join(
        f'CAST(SUM(LENGTH("{n}")) AS DOUBLE) / COUNT("{n}") AS "m_{n}"' for n in names
    )
    sizes = ",\n    ".join(f'COALESCE(("m_{n}" - 2) * 4 / 8, 0.0) * n AS "s_{n}"' for n in names)
    total = " + ".join(f'"s_{n}"' for n in names)
    rows = "\nUNION ALL\n".join(
        f"SELECT '{n}' AS column_name, \"s_{n}\" AS {value_name}"
        + (f', "s_{n}" / total * 100 AS percentage_saved' if with_share else "")
        + " FROM sized"
        for n in names
    )
    return f"""WITH {_blocks_cte()},
means AS (
  SELECT COUNT(*) AS n,
    {means}
  FROM blocks
),
sized AS (
  SELECT *, {total} AS total FROM (
    SELECT
    {sizes}
    FROM means
  )
)
{rows}"""


def _q1() -> str:
    return f"SELECT {_MONTH} AS month, COUNT(*) AS n FROM tx WHERE ts_digits GROUP BY 1"


def _q2() -> str:
    return (
        f"SELECT {_MONTH} AS month, {_dbl('SUM(value)')} / COUNT(*) AS avg_value "
        "FROM tx WHERE value_ok AND ts_digits GROUP BY 1"
    )


def _q3() -> str:
    return (
        "SELECT s.address, s.value FROM ("
        "SELECT to_address AS address, CAST(SUM(value) AS DECIMAL(38,0)) AS value "
        "FROM tx WHERE block_ok AND value IS NOT NULL GROUP BY 1) s "
        "JOIN contracts c ON s.address = c.address ORDER BY s.value DESC, s.address LIMIT 10"
    )


def _q4() -> str:
    return (
        "SELECT miner, CAST(SUM(CAST(floor(o_totalprice) AS BIGINT)) AS DECIMAL(38,0)) AS size FROM ("
        "SELECT '0x' || lpad(lower(hex(o_custkey)), 40, '0') AS miner, o_totalprice FROM orders) "
        "GROUP BY miner ORDER BY size DESC, miner LIMIT 10"
    )


def _q5() -> str:
    return (
        f"SELECT id, category, {_dbl('SUM(value)')} AS ether "
        "FROM tx JOIN scams ON tx.to_address = scams.address WHERE value_ok "
        "GROUP BY id, category ORDER BY ether DESC, id, category LIMIT 15"
    )


def _q6_cells() -> str:
    return (
        f"SELECT {_MONTH} AS month, id, category, {_dbl('SUM(value)')} AS ether "
        "FROM tx JOIN scams ON tx.to_address = scams.address WHERE value_ok AND ts IS NOT NULL "
        "GROUP BY 1, 2, 3"
    )


def _q7() -> str:
    return (
        f"SELECT {_MONTH} AS month, {_dbl('SUM(gas_price)')} / COUNT(*) AS avg_gas_price "
        "FROM tx WHERE gp_ok AND ts_numeric AND ts IS NOT NULL GROUP BY 1"
    )


def _q8() -> str:
    return (
        f"SELECT {_MONTH} AS month, {_dbl('SUM(gas)')} / COUNT(*) AS avg_gas "
        "FROM tx JOIN contracts ON tx.to_address = contracts.address "
        "WHERE gp_ok AND ts_numeric AND ts IS NOT NULL GROUP BY 1"
    )


def _grid(inner: str, value: str, zero: str, cast: str) -> str:
    return f"""WITH {_TX.strip()},
monthly AS ({inner}),
cells AS (
  SELECT CAST(substr(month, 4, 4) AS INTEGER) AS year, CAST(substr(month, 1, 2) AS INTEGER) AS month,
         SUM({value}) AS v
  FROM monthly GROUP BY 1, 2
),
grid AS (SELECT y.year, CAST(g.m AS INTEGER) AS month FROM (SELECT DISTINCT year FROM cells) y, range(1, 13) g(m))
SELECT grid.year, grid.month, strftime(make_date(grid.year, grid.month, 1), '%b') AS month_name,
       CAST(COALESCE(cells.v, {zero}) AS {cast}) AS {value}
FROM grid LEFT JOIN cells ON grid.year = cells.year AND grid.month = cells.month"""


def _panels(inner: str, value: str, ctes: str) -> str:
    return f"""WITH {ctes},
monthly AS ({inner})
SELECT CAST(year(strptime(month, '%m/%Y')) AS INTEGER) AS year,
       CAST(strptime(month, '%m/%Y') AS DATE) AS month, {value}
FROM monthly WHERE year(strptime(month, '%m/%Y')) <> 2001"""


def oracle_sql() -> dict[str, str]:
    tx = _TX.strip()
    c = _CONTRACTS.strip()
    s = _SCAMS.strip()
    cats = ("AFRICA", "ASIA", "EUROPE", "MIDDLE EAST", "Scamming")
    pivot_cols = ", ".join(f"SUM(CASE WHEN category = '{k}' THEN ether END) AS \"{k}\"" for k in cats)
    sql = {
        "q1_monthly_count": f"WITH {tx} {_q1()}",
        "q2_monthly_avg_value": f"WITH {tx} {_q2()}",
        "q3_top_services": f"WITH {tx}, {c} {_q3()}",
        "q4_top_miners": _q4(),
        "q5_top_scams": f"WITH {tx}, {s} {_q5()}",
        "q6_scam_by_month": f"WITH {tx}, {s} {_q6_cells()}",
        "q6_by_ether": (
            f"WITH {tx}, {s}, cells AS ({_q6_cells()}) "
            "SELECT ROW_NUMBER() OVER (ORDER BY ether DESC, month, id, category) AS row_number, month, id, category, ether FROM cells"
        ),
        "q7_monthly_gas_price": f"WITH {tx} {_q7()}",
        "q8_contract_gas": f"WITH {tx}, {c} {_q8()}",
        "q9_column_space": _space_rows(list(_HEX_COLUMNS), "size_bytes", with_share=False),
        "q10_space_share": _space_rows(list(_BLOCK_COLUMNS), "space_saved", with_share=True),
        "q11_count_grid": _grid(_q1(), "n", "0", "BIGINT"),
        "q12_avg_grid": _grid(_q2(), "avg_value", "0.0", "DOUBLE"),
        "q13_ranked_services": (
            f"WITH {tx}, {c}, top AS ({_q3()}) "
            "SELECT CAST(ROW_NUMBER() OVER (ORDER BY value DESC, address) AS INTEGER) AS rank, address, value FROM top"
        ),
        "q14_ranked_miners": (
            f"WITH top AS ({_q4()}) "
            "SELECT CAST(ROW_NUMBER() OVER (ORDER BY size DESC, miner) AS INTEGER) AS rank, miner, size FROM top"
        ),
        "q15_scam_table": (
            f"WITH {tx}, {s}, top AS ({_q5()}) "
            "SELECT id AS scam_id, category AS scam_type, ether FROM top"
        ),
        "q16_scam_pivot": (
            f"WITH {tx}, {s}, cells AS ("
            f"SELECT CAST(year(make_timestamp(ts * 1000000)) AS INTEGER) AS year, "
            f"CAST(month(make_timestamp(ts * 1000000)) AS INTEGER) AS month, category, {_dbl('SUM(value)')} AS ether "
            "FROM tx JOIN scams ON tx.to_address = scams.address WHERE value_ok AND ts IS NOT NULL "
            f"GROUP BY 1, 2, 3) SELECT year, month, {pivot_cols} FROM cells GROUP BY year, month"
        ),
        "q17_gas_price_panels": _panels(_q7(), "avg_gas_price", tx),
        "q18_gas_panels": _panels(_q8(), "avg_gas", f"{tx}, {c}"),
        "rules_transactions": """
SELECT 15 AS n_fields, TRUE AS block_ok, TRUE AS value_ok, TRUE AS gas_price_ok, TRUE AS ts_digits,
       TRUE AS ts_numeric, COUNT(*) AS "rows" FROM lineitem
UNION ALL SELECT 15, FALSE, TRUE, TRUE, TRUE, TRUE, COUNT(*) FROM customer
UNION ALL SELECT 15, TRUE, FALSE, TRUE, TRUE, TRUE, COUNT(*) FROM part
UNION ALL SELECT 15, TRUE, TRUE, FALSE, TRUE, TRUE, COUNT(*) FROM supplier
UNION ALL SELECT 15, TRUE, TRUE, TRUE, FALSE, FALSE, COUNT(*) FROM nation
UNION ALL SELECT 15, TRUE, TRUE, TRUE, FALSE, TRUE, COUNT(*) FROM region
UNION ALL SELECT 15, FALSE, FALSE, FALSE, FALSE, FALSE, CAST(1 AS BIGINT)
UNION ALL SELECT 1, FALSE, FALSE, FALSE, FALSE, FALSE, COUNT(*) FROM region
UNION ALL SELECT 16, FALSE, FALSE, FALSE, FALSE, FALSE, COUNT(*) FROM orders
UNION ALL SELECT 14, FALSE, FALSE, FALSE, FALSE, FALSE, COUNT(*) FROM events""",
        "rules_contracts": """
SELECT 6 AS n_fields, TRUE AS well_formed,
       1 + (SELECT COUNT(*) FROM supplier) + (SELECT COUNT(*) FROM nation) AS "rows"
UNION ALL SELECT 7, FALSE, COUNT(*) FROM region""",
        "rules_blocks": """
SELECT 19 AS n_fields, TRUE AS well_formed, TRUE AS size_ok, COUNT(*) AS "rows" FROM orders
UNION ALL SELECT 19, FALSE, FALSE, CAST(1 AS BIGINT)
UNION ALL SELECT 18, FALSE, FALSE, COUNT(*) FROM customer
UNION ALL SELECT 19, TRUE, FALSE, COUNT(*) FROM part""",
        "scam_rows": """
WITH base AS (
  SELECT s_suppkey, s_acctbal, n_name, CAST(s_nationkey AS VARCHAR) AS id,
         CASE WHEN r_name = 'AMERICA' THEN 'Scamming' ELSE r_name END AS category
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE s_acctbal >= 0
),
addr AS (
  SELECT *, '0xs' || s_suppkey AS address FROM base
  UNION ALL SELECT *, '0xs' || (s_suppkey + 1) FROM base
)
SELECT id, n_name AS name, 'https://scam.example/' || s_suppkey AS url, 'ETH' AS coin, category,
       CASE WHEN s_acctbal > 5000 THEN n_name ELSE '' END AS subcategory, address,
       CASE WHEN s_acctbal >= 1000 THEN 'Active' ELSE 'None' END AS status
FROM addr""",
    }
    w = _WIDE_TX.strip()
    sql |= {
        "q6_array_round_trip": sql["q6_scam_by_month"],
        "scam_rows_one_document": sql["scam_rows"],
        "q5_one_document": sql["q5_top_scams"],
        "q3_large_list": sql["q3_top_services"],
        "q5_large_list": sql["q5_top_scams"],
        "q6_large_list": sql["q6_scam_by_month"],
        "q8_large_list": sql["q8_contract_gas"],
        "q2_long_values": f"WITH {w} SELECT {_MONTH} AS month, CAST({_wide_total(52)} AS DOUBLE) / COUNT(*) AS avg_value FROM wide GROUP BY 1",
        "q3_long_values": (
            f"WITH {w}, {c}, sums AS (SELECT to_address AS address, SUM(front) AS f, SUM(back) AS b, {_wide_total(52)} AS value "
            "FROM wide GROUP BY 1) SELECT s.address, s.value FROM sums s JOIN contracts c ON s.address = c.address "
            "ORDER BY s.f DESC, s.b DESC, s.address LIMIT 10"
        ),
        "q4_long_sizes": (
            "WITH sizes AS (SELECT '0xm' || o_custkey AS miner, CAST(floor(o_totalprice * 100) AS BIGINT) AS front, "
            "CAST(o_orderkey AS BIGINT) AS back FROM orders), "
            f"sums AS (SELECT miner, SUM(front) AS f, SUM(back) AS b, {_wide_total(40)} AS size FROM sizes GROUP BY 1) "
            "SELECT miner, size FROM sums ORDER BY f DESC, b DESC, miner LIMIT 10"
        ),
        "q7_fractions": f"WITH {w} SELECT {_MONTH} AS month, {_scaled_mean('SUM(price_parts)', 5)} AS avg_gas_price FROM wide GROUP BY 1",
        "q8_fractions": (
            f"WITH {w}, {c} SELECT {_MONTH} AS month, {_scaled_mean('SUM(gas_thousandths)', 3)} AS avg_gas "
            "FROM wide JOIN contracts ON wide.to_address = contracts.address GROUP BY 1"
        ),
    }
    if llm_registry is not None:
        sql |= llm_registry.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {k: v.strip() for k, v in sql.items()}
