"""Staged Parquet inputs give exactly the results of the text inputs."""

from __future__ import annotations

from chainlens.plans.catalog import FileInputs, StagedInputs, build
from chainlens.sources.staging import stage_ledger

from ledger_lines import plan_text


def test_staged_equals_text_for_every_query(spark, files, tmp_path):
    paths = {
        "transactions": files["transactions.csv"],
        "contracts": files["contracts.csv"],
        "blocks": files["blocks.csv"],
        "blocks_csv": files["blocks_table.csv"],
        "scams": files["scams.json"],
    }
    staged = stage_ledger(spark, {k: paths[k] for k in ("transactions", "contracts", "blocks")}, str(tmp_path / "st"))
    text_q, staged_q = build(FileInputs(spark, paths)), build(StagedInputs(spark, paths, staged))
    for name in text_q:
        a, b = text_q[name](), staged_q[name]()
        assert a.schema == b.schema, name
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr), name


def test_staged_scan_reads_few_columns_with_pushed_filters(spark, files, tmp_path):
    staged = stage_ledger(spark, {"transactions": files["transactions.csv"]}, str(tmp_path / "st2"))
    from chainlens.plans import queries as Q
    from chainlens.sources.staging import read_staged

    text = plan_text(Q.monthly_transaction_count(read_staged(spark, staged["transactions"])))
    schema_line = next(ln for ln in text.splitlines() if ln.startswith("ReadSchema"))
    assert "to_address" not in schema_line and "value_i0" not in schema_line
    assert "PushedFilters" in text and "ts_digits" in text.split("PushedFilters")[1].split("\n")[0]
