"""Rows that pass the rules are never lost: long, padded and fractional numbers, far times, broken scam lists."""

from __future__ import annotations

import json

import pytest

from chainlens.plans import queries as Q
from chainlens.sources.ledger import parse_blocks, parse_contracts, parse_transactions
from chainlens.sources.scam_list import parse_scams

NINES = "9" * 41
PADDED = "0" * 40 + "7"
TIME = 1454284800


def tx(spark, *rows):
    """Transactions of ``(value, gas, gas price, time)`` to 0xaa."""
    lines = [f"h,0,b,1,0,0xf,0xaa,{v},{g},{p},0x,{t},,," for v, g, p, t in rows]
    return parse_transactions(spark.createDataFrame([(x,) for x in lines], "value string"))


def contracts(spark):
    return parse_contracts(spark.createDataFrame([("0xaa,,,,,1",)], "value string"))


def scam_doc(**change):
    entry = {"id": 1, "name": "n", "url": "u", "coin": "c", "category": "Scam", "addresses": ["0xaa"], "status": None}
    entry = {k: v for k, v in (entry | change).items() if v != "absent"}
    return json.dumps({"success": True, "result": {"0xk": entry}})


def scams(spark, *docs):
    return parse_scams(spark.createDataFrame([(d,) for d in docs], "value string"))


def test_averages_take_numbers_of_any_length(spark):
    values = [PADDED, NINES, "5.25", "000.5", "3"]
    got = Q.monthly_average_value(tx(spark, *[(v, 1, 1, TIME) for v in values])).collect()
    assert [(r.month, r.avg_value) for r in got] == [("02/2016", pytest.approx(sum(map(float, values)) / 5, rel=1e-15))]


def test_gas_takes_numbers_of_any_length(spark):
    rows = tx(spark, ("1", PADDED, NINES, TIME), ("1", NINES, "2.5", TIME))
    assert Q.monthly_gas_price(rows).first().avg_gas_price == pytest.approx((float(NINES) + 2.5) / 2, rel=1e-15)
    assert Q.monthly_contract_gas(rows, contracts(spark)).first().avg_gas == pytest.approx((7 + float(NINES)) / 2, rel=1e-15)


def test_scams_take_numbers_of_any_length(spark):
    rows = tx(spark, (PADDED, 1, 1, TIME), (NINES, 1, 1, TIME))
    want = pytest.approx(7 + float(NINES), rel=1e-15)
    assert Q.top_scams(rows, scams(spark, scam_doc())).first().ether == want
    assert Q.scam_value_by_month(rows, scams(spark, scam_doc())).first().ether == want


def test_exact_sums_take_padded_numbers_and_stop_at_longer_ones(spark):
    rows = [(PADDED, 1, 1, TIME), ("+5", 1, 1, TIME), ("-2", 1, 1, TIME), ("9" * 37, 1, 1, TIME)]
    assert int(Q.top_services(tx(spark, *rows), contracts(spark)).first().value) == 10 + int("9" * 37)
    with pytest.raises(Exception, match="more than 38 digits"):
        Q.top_services(tx(spark, (NINES, 1, 1, TIME)), contracts(spark)).collect()


def test_sums_of_any_length(spark):
    values = ["9" * 60, "1", "-" + "3" * 90, "9" * 90, "+" + "0" * 70 + "12", "8" * 38, "8" * 38]
    rows = tx(spark, *[(v, 1, 1, TIME) for v in values])
    for bound in (None, 0):
        got = Q.service_totals(rows, contracts(spark), max_broadcast_bytes=bound).collect()
        assert [tuple(r) for r in got] == [("0xaa", str(sum(map(int, values))))]
    # two numbers of 38 digits have a sum that does not fit, and is an error there, not a wrong number
    with pytest.raises(Exception, match="more than 38 digits"):
        Q.top_services(tx(spark, ("8" * 38, 1, 1, TIME), ("8" * 38, 1, 1, TIME)), contracts(spark)).collect()


def test_order_of_long_and_negative_sums(spark):
    values = {"0xa": "-5", "0xb": "9" * 60, "0xc": "-" + "9" * 60, "0xd": "0", "0xe": "1" + "0" * 59, "0xf": "77", "0xg": "-05"}
    lines = [f"h,0,b,1,0,0xf,{a},{v},1,1,0x,{TIME},,," for a, v in values.items()]
    rows = parse_transactions(spark.createDataFrame([(x,) for x in lines], "value string"))
    listed = parse_contracts(spark.createDataFrame([(f"{a},,,,,1",) for a in values], "value string"))
    got = [r.address for r in Q.service_totals(rows, listed).collect()]
    assert got == sorted(values, key=lambda a: (-int(values[a]), a))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_fractions_add_up_in_any_order(spark, parts):
    """0.1 + ... as exact decimals, rounded once: the same bits over any partitions."""
    from fractions import Fraction

    prices = [f"{k % 7}.{k:03d}" for k in range(1, 200)] + ["1e22", "0.1", ".3", "123456789012345678901234567890.7"] * 3
    gas = [f"{k}.1" for k in range(len(prices))]
    lines = [f"h,0,b,1,0,0xf,0xaa,{p if 'e' not in p else 1},{g},{p if 'e' not in p else 2},0x,{TIME},,," for p, g in zip(prices, gas)]
    rows = parse_transactions(spark.createDataFrame([(x,) for x in lines], "value string").repartition(parts))
    plain = [p if "e" not in p else "2" for p in prices]
    mean = lambda texts: float(sum(map(Fraction, texts))) / len(texts)
    assert Q.monthly_gas_price(rows).first().avg_gas_price == mean(plain)
    assert Q.monthly_contract_gas(rows, contracts(spark)).first().avg_gas == mean(gas)
    assert Q.monthly_average_value(rows).first().avg_value == mean([p if "e" not in p else "1" for p in prices])
    total = float(sum(Fraction(p if "e" not in p else "1") for p in prices))
    assert Q.top_scams(rows, scams(spark, scam_doc())).first().ether == total


def test_a_long_number_that_the_rules_drop_stops_nothing(spark):
    bad = parse_transactions(spark.createDataFrame([(f"h,0,b,x,0,0xf,0xaa,{NINES},1,1,0x,1,,,",)], "value string"))
    assert Q.top_services(bad.unionByName(tx(spark, ("4", 1, 1, TIME))), contracts(spark)).first().value == 4


def test_block_sizes_beyond_64_bits(spark):
    def blocks(*sizes):
        lines = [f"1,0xh,,,,,,,,0xm,,,{s},,,,,," for s in sizes]
        return parse_blocks(spark.createDataFrame([(x,) for x in lines], "value string"))

    sizes = [2**63, 2**70, PADDED]
    assert int(Q.top_miners(blocks(*sizes)).first()["size"]) == sum(map(int, sizes))
    with pytest.raises(Exception, match="more than 38 digits"):
        Q.top_miners(blocks(NINES)).collect()


@pytest.mark.parametrize(
    ("seconds", "month"), [(1454284800000, "06/48054"), (253402300800, "01/10000"), (0, "01/1970"), (-1, "12/1969")]
)
def test_times_of_any_year(spark, seconds, month):
    rows = tx(spark, ("3", 1, 2, seconds), ("3", 1, 2, "9" * 30))
    found = Q.scam_value_by_month(rows, scams(spark, scam_doc())).collect()
    assert [(r.month, r.ether) for r in found] == [(month, 3.0)]
    if seconds >= 0:
        assert [tuple(r) for r in Q.monthly_transaction_count(rows).collect()] == [(month, 1)]
    from chainlens.plans.reports import count_grid

    if seconds >= 0:
        grid = count_grid(Q.monthly_transaction_count(rows)).where("n > 0").first()
        assert (grid.year, grid.month) == (int(month[3:]), int(month[:2]))


@pytest.mark.parametrize(
    ("doc", "message"),
    [
        (scam_doc()[:-9], "Malformed|MALFORMED"),
        ('{"success": true}', "with 'result'"),
        (scam_doc(name="absent"), "without 'name'"),
        (scam_doc(addresses="absent"), "without 'addresses'"),
        (scam_doc(addresses="0xaa"), "not an array"),
    ],
)
def test_a_broken_scam_list_is_an_error(spark, doc, message):
    with pytest.raises(Exception, match=message):
        scams(spark, scam_doc(), doc).collect()


def test_a_whole_scam_list_passes(spark):
    got = scams(spark, "", scam_doc(), scam_doc(name="a, b"), scam_doc(id="x1"), "  ").collect()
    assert [(r.id, r.category, r.subcategory, r.address, r.status) for r in got] == [("1", "Scamming", "", "0xaa", "None")]
