"""A query writes the ledger files that it reads and no others, compressed, in files of bounded length."""

from __future__ import annotations

import glob
import gzip

import pytest

from chainlens.plans import catalog
from chainlens.session import ensure_checkpoint_dir
from chainlens.sources import star

DAY = "timestamp_ntz'1996-03-05 00:00:00' + make_dt_interval(id)"
TABLES = {
    "lineitem": f"id l_orderkey, id % 7 l_partkey, id % 5 l_suppkey, cast(id % 3 as int) l_linenumber, double(id) l_extendedprice, double(id % 50) l_quantity, {DAY} l_shipdate",
    "customer": "id c_custkey, cast(id % 4 as int) c_nationkey",
    "part": "id p_partkey, cast(id % 50 as int) p_size",
    "supplier": "id s_suppkey, cast(id % 4 as int) s_nationkey, double(id * 100) s_acctbal",
    "nation": "cast(id as int) n_nationkey, concat('n', id) n_name, cast(id % 2 as int) n_regionkey",
    "region": "cast(id as int) r_regionkey, concat('r', id) r_name",
    "orders": f"id o_orderkey, id % 9 o_custkey, 'O' o_orderstatus, '5-LOW' o_orderpriority, double(id * 1000) o_totalprice, {DAY} o_orderdate",
    "events": f"id event_id, id % 3 user_id, {DAY} ts",
}
# what each query reads
READS = {
    "q5_large_list": {"transactions", "scams"},
    "q6_large_list": {"transactions", "scams"},
    "q8_large_list": {"transactions", "contracts"},
    "q13_ranked_services": {"transactions", "contracts"},
    "q3_long_values": {"wide_transactions", "contracts"},
    "q8_fractions": {"wide_transactions", "contracts"},
    "q10_space_share": {"blocks_csv"},
    "q4_long_sizes": {"wide_blocks"},
    "rules_blocks": {"blocks"},
    "q5_one_document": {"transactions", "scams_document"},
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, columns in TABLES.items():
        rows = {"nation": 4, "region": 2}.get(name, 60)
        spark.sql(f"select {columns} from range(0, {rows}, 1, 1)").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def kept(spark, monkeypatch):
    """The ledger files that were written since the test began."""
    monkeypatch.setattr(catalog, "_INPUTS", {})
    pattern = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/ledger-*/*"
    before = set(glob.glob(pattern))
    return lambda: {path.rsplit("/", 1)[1].split("-")[0]: path for path in set(glob.glob(pattern)) - before}


@pytest.mark.parametrize("name", sorted(READS))
def test_a_query_writes_what_it_reads(spark, tables, kept, name):
    catalog.run(name, spark, tables)
    assert set(kept()) == READS[name]


def test_files_are_written_once(spark, tables, kept):
    rows = catalog.run("q8_large_list", spark, tables).collect()
    first = kept()
    assert rows == catalog.run("q8_contract_gas", spark, tables).collect()
    assert kept() == first
    assert rows == catalog.build(catalog.LedgerInputs(spark, tables))["q8_large_list"]().collect()


def test_compressed_files_of_bounded_length(spark, tables, kept, monkeypatch):
    monkeypatch.setattr(star, "LINES_PER_FILE", 25)
    share = {r["column_name"]: r["space_saved"] for r in catalog.run("q10_space_share", spark, tables).collect()}
    parts = glob.glob(f"{kept()['blocks_csv']}/part-*")
    assert len(parts) == 3 and all(p.endswith(".csv.gz") for p in parts)
    # a header in every file
    assert sorted(len(gzip.open(p).readlines()) for p in parts) == [11, 26, 26]
    plain = catalog.build(catalog.LedgerInputs(spark, tables))["q10_space_share"]().collect()
    assert share == {r["column_name"]: r["space_saved"] for r in plain}
