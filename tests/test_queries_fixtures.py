"""Q1-Q10 and Q11/Q16 on hand-made ledger lines with hand-computed answers.

Each malformed line breaks one rule; the comments say which queries it
leaves.  Expected values follow from the rules by hand (see FIXTURES.md).
"""

from __future__ import annotations

from decimal import Decimal

import pytest

from chainlens.operators import profile
from chainlens.plans import queries as Q
from chainlens.plans import reports as R
from chainlens.sources.ledger import read_blocks, read_blocks_table, read_contracts, read_transactions
from chainlens.sources.scam_list import read_scams


@pytest.fixture(scope="module")
def tx(spark, files):
    return read_transactions(spark, files["transactions.csv"])


@pytest.fixture(scope="module")
def contracts(spark, files):
    return read_contracts(spark, files["contracts.csv"])


@pytest.fixture(scope="module")
def scams(spark, files):
    return read_scams(spark, files["scams.json"])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_q1_monthly_count(tx):
    # h1/h2 straddle the UTC month border; h8 (bad time), h9 (14 fields),
    # h10 (16 fields) and the empty line are out.
    assert dict(rows(Q.monthly_transaction_count(tx))) == {"12/2015": 1, "01/2016": 2, "02/2016": 4}


def test_q2_monthly_average(tx):
    # h6 ('1e3') is not numeric-like; the 26-digit value stays exact.
    got = dict(rows(Q.monthly_average_value(tx)))
    assert got == {"12/2015": 10.0, "01/2016": 4.207768184997088e25, "02/2016": 37.333333333333336}


def test_q3_top_services_keeps_fanout(tx, contracts):
    # 0xaa is listed twice -> two rows; '' (h4) is no contract; h5 fails the
    # block guard; h6 cannot be converted by int() and is dropped.
    got = rows(Q.top_services(tx, contracts))
    assert got == [
        ("0xbb", Decimal("84155363699941767867374641")),
        ("0xaa", Decimal(56)),
        ("0xaa", Decimal(56)),
    ]
    assert rows(Q.top_services(tx, contracts, distinct_contracts=True)) == got[:2]


def test_q3_fail_mode_raises(tx, contracts):
    with pytest.raises(Exception, match="unconvertible value"):
        Q.top_services(tx, contracts, on_bad="fail").collect()


def test_q4_top_miners(spark, files):
    blocks = read_blocks(spark, files["blocks.csv"])
    assert rows(Q.top_miners(blocks)) == [("0xm2", 1300), ("0xm1", 540)]


def test_scam_rows(scams):
    got = sorted(rows(scams))
    assert got == [
        ("1", "A", "u1", "ETH", "Scamming", "", "0xaa", "Active"),
        ("1", "A", "u1", "ETH", "Scamming", "", "0xbb", "Active"),
        ("2", "B", "u2", "ETH", "Phishing", "Wallet", "0xaa", "None"),
    ]


def test_q5_top_scams(tx, scams):
    got = rows(Q.top_scams(tx, scams))
    assert got == [("1", "Scamming", float(84155363699941767867374797)), ("2", "Phishing", 156.0)]


def test_q6_scam_by_month(tx, scams):
    got = {(m, i): v for m, i, _, v in rows(Q.scam_value_by_month(tx, scams))}
    assert got == {
        ("12/2015", "1"): 10.0,
        ("12/2015", "2"): 10.0,
        ("01/2016", "1"): float(84155363699941767867374671),
        ("01/2016", "2"): 30.0,
        ("02/2016", "1"): 107.0,
        ("02/2016", "2"): 107.0,
    }


def test_q6_fail_mode_raises_on_bad_time(tx, scams):
    with pytest.raises(Exception, match="unconvertible"):
        Q.scam_value_by_month(tx, scams, on_bad="fail").collect()


def test_q7_text_order(tx):
    got = rows(Q.monthly_gas_price(tx))
    assert got == [("01/2016", 7.0), ("02/2016", 3.3333333333333335), ("12/2015", 4.0)]


@pytest.mark.parametrize("bound", [None, 0])
def test_q8_contract_gas_both_join_paths(tx, contracts, bound):
    # bound=0 forces the pre-aggregate + shuffle join path.
    got = rows(Q.monthly_contract_gas(tx, contracts, max_broadcast_bytes=bound))
    assert got == [("01/2016", 53333.333333333336), ("02/2016", 21000.0), ("12/2015", 21000.0)]


def test_q9_q10_column_space(spark, files):
    blocks = read_blocks_table(spark, files["blocks_table.csv"])
    q9 = dict(rows(profile.column_space(blocks)))
    assert q9 == {
        "logs_bloom": 6.0,
        "sha3_uncles": 3.0,
        "transactions_root": 3.0,
        "state_root": 3.0,
        "receipts_root": 3.0,
    }
    q10 = {name: (space, pct) for name, space, pct in rows(profile.column_space_share(blocks))}
    expected = {
        "number": -1.0, "hash": 3.0, "parent_hash": 3.0, "nonce": 6.0, "sha3_uncles": 3.0,
        "logs_bloom": 6.0, "transactions_root": 3.0, "state_root": 3.0, "receipts_root": 3.0,
        "miner": 3.0, "difficulty": 0.0, "total_difficulty": 0.0, "size": 1.5, "extra_data": 4.5,
        "gas_limit": 3.0, "gas_used": 0.5, "timestamp": 7.5, "transaction_count": -1.0,
        "base_fee_per_gas": 0.0,
    }
    assert list(q10) == list(expected)
    for name, want in expected.items():
        assert q10[name][0] == pytest.approx(want, abs=1e-12)
        assert q10[name][1] == pytest.approx(want / 48.0 * 100, abs=1e-9)
    assert sum(p for _, p in q10.values()) == pytest.approx(100.0)
    derived = dict(rows(profile.column_space_from_share(profile.column_space_share(blocks))))
    assert derived == pytest.approx(q9)


def test_q11_dense_grid(tx):
    grid = rows(R.count_grid(Q.monthly_transaction_count(tx)))
    assert len(grid) == 24
    nonzero = {(y, m): n for y, m, _, n in grid if n}
    assert nonzero == {(2015, 12): 1, (2016, 1): 2, (2016, 2): 4}
    assert grid[0][:3] == (2015, 1, "Jan") and grid[-1][:3] == (2016, 12, "Dec")


def test_q16_pivot_nulls_for_absent(tx, scams):
    piv = R.scam_pivot(Q.scam_value_by_month(tx, scams))
    assert piv.columns == ["year", "month", "Phishing", "Scamming"]
    assert len(rows(piv)) == 3
    exact = R.scam_pivot_exact(Q.scam_month_base(tx, scams), ["Phishing", "Scamming", "Fake ICO"])
    got = rows(exact)
    assert got[0] == (2015, 12, 10.0, 10.0, None)


def test_q13_q14_rank(tx, contracts, spark, files):
    ranked = rows(R.ranked_services(Q.top_services(tx, contracts)))
    assert [r[0] for r in ranked] == [1, 2, 3]
    miners = rows(R.ranked_miners(Q.top_miners(read_blocks(spark, files["blocks.csv"]))))
    assert miners == [(1, "0xm2", 1300), (2, "0xm1", 540)]


def test_q17_panels(tx):
    panels = rows(R.gas_price_panels(Q.monthly_gas_price(tx), drop_years=[2015]))
    assert [(y, d.month) for y, d, _ in panels] == [(2016, 1), (2016, 2)]


def test_q7_fail_mode_only_on_guarded_unconvertible_time(spark, files):
    from chainlens.sources.ledger import parse_transactions

    base = open(files["transactions.csv"]).read().splitlines()
    # The fixture alone has no line that passes Q7's guard yet fails int():
    tx = parse_transactions(spark.createDataFrame([(x,) for x in base], "value string"))
    assert len(Q.monthly_gas_price(tx, on_bad="fail").collect()) == 3
    # '1451606400.5' is numeric-like (guard passes) but not an int.
    bad = "hx,0,b,1,0,0xf,0xaa,1,21000,4,0x,1451606400.5,,,"
    tx = parse_transactions(spark.createDataFrame([(x,) for x in base + [bad]], "value string"))
    with pytest.raises(Exception, match="unconvertible"):
        Q.monthly_gas_price(tx, on_bad="fail").collect()
    assert len(Q.monthly_gas_price(tx).collect()) == 3  # dropped by default


def test_q10_with_inferred_types(spark, files):
    # The reference infers column types; plain integers measure the same.
    typed = read_blocks_table(spark, files["blocks_table.csv"], infer_schema=True)
    assert dict(typed.dtypes)["number"] in ("int", "bigint")
    got = {name: space for name, space, _ in rows(profile.column_space_share(typed))}
    plain = {name: space for name, space, _ in rows(profile.column_space_share(read_blocks_table(spark, files["blocks_table.csv"])))}
    assert got == pytest.approx(plain)
