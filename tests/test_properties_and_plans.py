"""Invariance properties and physical-plan shape.

* results do not depend on line order or partitioning (exact sums);
* appending malformed lines changes nothing;
* top-k is planned as TakeOrderedAndProject, the scam join is a broadcast
  hash join, and no plan contains a Python UDF.
"""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chainlens.plans import queries as Q
from chainlens.plans.catalog import LedgerInputs, build
from chainlens.sources.ledger import parse_contracts, parse_transactions
from chainlens.sources.scam_list import read_scams

from ledger_lines import TRANSACTIONS_CSV, plan_text

# Each line fails the rule set of every query: wrong field count, or a
# block number, value and block time that are all invalid in some form.
MALFORMED = [
    "",
    "a,b,c",
    "x," * 15,
    "h,0,b,-1,0,0xf,0xaa,-5,21000,4,0x,-1454284800,,,",
    "h,0,b,1e3,0,0xf,0xaa,1.2.3,21000,4,0x,1454284800.5.5,,,",
    "h,0,b, 7,0,0xf,0xaa,1e5,21000,4,0x, 1454284800,,,",
    "h,0,b,0x1,0,0xf,0xaa,.,21000,4,0x,,,,",
]


def lines_df(spark, lines, partitions):
    return spark.createDataFrame([(x,) for x in lines], "value string").repartition(partitions)


def results(tx, contracts, scams):
    return {
        "q1": sorted(Q.monthly_transaction_count(tx).collect()),
        "q2": sorted(Q.monthly_average_value(tx).collect()),
        "q3": Q.top_services(tx, contracts).collect(),
        "q5": Q.top_scams(tx, scams).collect(),
        "q6": sorted(Q.scam_value_by_month(tx, scams).collect()),
        "q7": Q.monthly_gas_price(tx).collect(),
        "q8": Q.monthly_contract_gas(tx, contracts).collect(),
    }


@pytest.fixture(scope="module")
def base(spark, files):
    contracts = parse_contracts(spark.read.text(files["contracts.csv"]))
    scams = read_scams(spark, files["scams.json"])
    lines = TRANSACTIONS_CSV.splitlines()
    tx = parse_transactions(lines_df(spark, lines, 1))
    return lines, contracts, scams, results(tx, contracts, scams)


@pytest.mark.parametrize("partitions,seed", [(3, 1), (7, 2)])
def test_order_and_partitioning_do_not_matter(spark, base, partitions, seed):
    import random

    lines, contracts, scams, expected = base
    shuffled = list(lines)
    random.Random(seed).shuffle(shuffled)
    tx = parse_transactions(lines_df(spark, shuffled, partitions))
    assert results(tx, contracts, scams) == expected


def test_malformed_lines_change_nothing(spark, base):
    lines, contracts, scams, expected = base
    tx = parse_transactions(lines_df(spark, lines + MALFORMED, 4))
    assert results(tx, contracts, scams) == expected


@pytest.fixture(scope="module")
def star_queries(spark):
    return build(LedgerInputs(spark, "/root/testdata/sf0.001"))


def test_topk_is_take_ordered(star_queries):
    for name in ("q3_top_services", "q4_top_miners", "q5_top_scams"):
        assert "TakeOrderedAndProject" in plan_text(star_queries[name]()), name


def test_scam_join_is_broadcast_and_transactions_not_shuffled_before_aggregate(star_queries):
    text = plan_text(star_queries["q6_scam_by_month"](), "simple")
    joins = [ln for ln in text.splitlines() if "Join" in ln and "to_address" in ln]
    assert joins and all("BroadcastHashJoin" in ln for ln in joins), joins


def test_no_python_in_any_plan(star_queries):
    for name, make in star_queries.items():
        text = plan_text(make())
        for node in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
            assert node not in text, (name, node)


def test_scan_reads_only_needed_columns(spark):
    from chainlens.sources import star

    lines = star.transaction_lines(spark, "/root/testdata/sf0.001")
    text = plan_text(Q.monthly_transaction_count(parse_transactions(lines)))
    # the lineitem scan of Q1's plan reads the columns the line needs, not
    # the flag/price columns it never touches
    assert "l_returnflag" not in text and "l_tax" not in text


def test_guards_read_split_array_not_line(spark, files):
    tx = parse_transactions(spark.read.text(files["transactions.csv"]))
    text = plan_text(Q.monthly_average_value(tx))
    filters = [ln for ln in text.splitlines() if ln.startswith("Condition")]
    assert filters and all("split(" not in ln for ln in filters)
    assert "Generate" in text


def test_shuffle_join_path_has_partial_aggregate_before_exchange(spark, files):
    tx = parse_transactions(spark.read.text(files["transactions.csv"]))
    contracts = parse_contracts(spark.read.text(files["contracts.csv"]))
    text = plan_text(Q.monthly_contract_gas(tx, contracts, max_broadcast_bytes=0))
    assert "partial_sum" in text and "BroadcastHashJoin Inner" not in text


def test_other_receivers_are_dropped_before_the_sums(spark, files):
    """Q3 with a small list: the join stands below the partial aggregate, whose keys hold the copies."""
    tx = parse_transactions(spark.read.text(files["transactions.csv"]))
    contracts = parse_contracts(spark.read.text(files["contracts.csv"]))
    tree = plan_text(Q.top_services(tx, contracts)).split("\n\n")[0].splitlines()
    # the tree prints parents first
    join = next(k for k, ln in enumerate(tree) if "BroadcastHashJoin" in ln)
    # the partial and final sums by limb, then the limbs of each address
    assert sum("Aggregate" in ln for ln in tree[:join]) == 4


def test_large_side_is_not_hinted(spark):
    from chainlens.operators.join import VALUE_BYTES, broadcast_if_small, byte_size

    df = spark.range(1000).selectExpr("id", "'abcd' AS t")
    size = byte_size(df)
    assert size == 1000 * (2 * VALUE_BYTES + 4)
    assert broadcast_if_small(df, size)[1] and not broadcast_if_small(df, size - 1)[1]
    joined = spark.range(10).join(broadcast_if_small(df, size)[0], "id")
    assert "BroadcastHashJoin" in plan_text(joined)


#: Inputs that a plan reads, and how often: a contract or scam list once, whatever the ledger's size.
def scans(text):
    """File names of a formatted plan's scans, one entry per scan node."""
    return [ln.rsplit("/", 1)[-1].rstrip("]") for ln in text.splitlines() if ln.startswith("Location:")]


def test_every_query_scans_each_input_once(spark, files, tmp_path):
    """No plan reads an input file twice (a self-join or re-scan would); what else it reads was stored by the query."""
    from chainlens.plans.catalog import FileInputs
    from chainlens.session import ensure_checkpoint_dir

    paths = {
        "transactions": files["transactions.csv"],
        "contracts": files["contracts.csv"],
        "blocks": files["blocks.csv"],
        "blocks_csv": files["blocks_table.csv"],
        "scams": files["scams.json"],
        "wide_transactions": files["transactions.csv"],
        "wide_blocks": files["blocks.csv"],
    }
    names = {path.rsplit("/", 1)[-1] for path in paths.values()}
    store = ensure_checkpoint_dir(spark)
    for name, make in build(FileInputs(spark, paths)).items():
        text = plan_text(make())
        found = scans(text)
        places = [ln for ln in text.splitlines() if ln.startswith("Location:")]
        read = [f for f, place in zip(found, places) if store not in place]
        assert found and set(read) <= names, (name, found)
        assert len(read) == len(set(read)), (name, found)


def test_a_large_list_filters_transactions_where_they_are_read(spark, files):
    """The Bloom filter's join stands below the partial sums, and no row of the list is broadcast."""
    tx = parse_transactions(spark.read.text(files["transactions.csv"]))
    contracts = parse_contracts(spark.read.text(files["contracts.csv"]))
    scams = read_scams(spark, files["scams.json"])
    for df in (
        Q.top_services(tx, contracts, max_broadcast_bytes=0),
        Q.top_scams(tx, scams, max_broadcast_bytes=0),
        Q.scam_value_by_month(tx, scams, max_broadcast_bytes=0),
        Q.monthly_contract_gas(tx, contracts, max_broadcast_bytes=0),
    ):
        tree = plan_text(df).split("\n\n")[0].splitlines()
        # the tree prints parents first
        semi = next(k for k, ln in enumerate(tree) if "BroadcastHashJoin LeftSemi" in ln)
        outer = next(k for k, ln in enumerate(tree) if "SortMergeJoin" in ln or "ShuffledHashJoin" in ln)
        between = tree[outer:semi]
        assert sum("Aggregate" in ln for ln in between) >= 2 and any("Exchange" in ln for ln in between)
        assert sum("BroadcastHashJoin" in ln for ln in tree) == 1


def test_the_filter_passes_all_listed_and_few_others(spark):
    from chainlens.operators.bloom import bloom_filter, maybe_listed

    listed = spark.range(20_000).select(F.concat(F.lit("0xs"), F.col("id") * 3).alias("address")).union(spark.createDataFrame([(None,)], "address string"))
    rows = spark.range(60_000).select(F.concat(F.lit("0xs"), "id").alias("to"), "id").union(spark.createDataFrame([(None, -1)], "to string, id long"))
    left = [r.id for r in maybe_listed(rows, "to", listed, "address").collect()]
    assert {k for k in range(60_000) if k % 3 == 0} <= set(left)
    assert len(left) == len(set(left)) and len(left) < 20_000 + 0.03 * 40_000
    table, words = bloom_filter(listed, "address")
    assert table.count() <= words <= 16 * 20_000 / 64 * 2 * 1.1
    # with too few words for the list, nothing is tested
    assert bloom_filter(listed, "address", max_words=64) is None
    assert maybe_listed(rows, "to", listed, "address", max_words=64).count() == 60_001
    none = listed.limit(0)
    assert maybe_listed(rows, "to", none, "address").count() == 0


@pytest.mark.parametrize("bound", [None, 0])
def test_large_and_small_lists_give_equal_results(spark, base, bound):
    lines, contracts, scams, expected = base
    tx = parse_transactions(lines_df(spark, lines, 3))
    got = {
        "q3": Q.top_services(tx, contracts, max_broadcast_bytes=bound).collect(),
        "q5": Q.top_scams(tx, scams, max_broadcast_bytes=bound).collect(),
        "q6": sorted(Q.scam_value_by_month(tx, scams, max_broadcast_bytes=bound).collect()),
        "q8": Q.monthly_contract_gas(tx, contracts, max_broadcast_bytes=bound).collect(),
    }
    assert got == {k: expected[k] for k in got}
