"""The batch jobs end to end on the fixture files: result shapes and values."""

from __future__ import annotations

import glob
import json
import os

import pytest

from chainlens.jobs import parser, run_job
from chainlens.plans import queries as Q
from chainlens.plans import reports as R
from chainlens.sources.ledger import read_blocks, read_contracts, read_transactions
from chainlens.sources.scam_list import read_scams


def read_one(path):
    parts = [p for p in glob.glob(os.path.join(path, "part-*")) if os.path.getsize(p) > 0]
    assert len(parts) == 1, parts
    return open(parts[0]).read()


def test_all_jobs(spark, files, tmp_path):
    out = str(tmp_path / "results")
    common = [
        "--transactions", files["transactions.csv"], "--contracts", files["contracts.csv"],
        "--scams", files["scams.json"], "--out", out, "--run-id", "t1",
    ]
    for job in ("time", "services", "scams", "gas"):
        run_job(spark, job, parser().parse_args([job, *common]))
    run_job(spark, "miners", parser().parse_args(["miners", "--blocks", files["blocks.csv"], *common]))
    run_job(spark, "overhead", parser().parse_args(["overhead", "--blocks", files["blocks_table.csv"], *common]))

    assert json.loads(read_one(f"{out}/monthly_counts_t1")) == [["01/2016", 2], ["02/2016", 4], ["12/2015", 1]]
    avgs = json.loads(read_one(f"{out}/monthly_averages_t1"))
    assert [a.split(",")[0] for a in avgs] == ["12/2015", "01/2016", "02/2016"]
    assert float(avgs[1].split(",")[1]) == 4.207768184997088e25
    assert json.loads(read_one(f"{out}/top_services_t1")) == [
        ["0xbb", 84155363699941767867374641], ["0xaa", 56], ["0xaa", 56],
    ]
    assert json.loads(read_one(f"{out}/top_miners_t1")) == [["0xm2", 1300], ["0xm1", 540]]
    assert json.loads(read_one(f"{out}/top_scams_t1")) == [
        [["1", "Scamming"], 8.415536369994176e25], [["2", "Phishing"], 156.0],
    ]
    by_month = [json.loads(ln) for p in glob.glob(f"{out}/scam_value_by_month_t1/part-*") for ln in open(p)]
    assert {"month": "02/2016", "id": "1", "category": "Scamming", "ether": 107.0} in by_month and len(by_month) == 6
    rejects = json.loads(read_one(f"{out}/rejects_time_t1"))
    assert rejects["rows"] == len(open(files["transactions.csv"]).read().splitlines())
    assert rejects["not_ts_digits"] == rejects["rows"] - 7
    assert json.loads(read_one(f"{out}/monthly_gas_price_t1")) == [
        ["01/2016", "7.0"], ["02/2016", "3.3333333333333335"], ["12/2015", "4.0"],
    ]
    assert json.loads(read_one(f"{out}/monthly_contract_gas_t1")) == [
        ["01/2016", "53333.333333333336"], ["02/2016", "21000.0"], ["12/2015", "21000.0"],
    ]
    csv = read_one(f"{out}/column_space_t1").splitlines()
    assert csv[0] == "column_name,size_bytes" and "logs_bloom,6.0" in csv

    run_job(spark, "reports", parser().parse_args(["reports", "--results", out, "--out", out + "/reports", "--run-id", "r"]))
    grid = read_one(f"{out}/reports/count_grid_r").splitlines()
    assert grid[0] == "year,month,month_name,n" and len(grid) == 25
    pivot = read_one(f"{out}/reports/scam_pivot_r").splitlines()
    assert pivot[0] == "year,month,Phishing,Scamming" and len(pivot) == 4


def test_jobs_on_staged_inputs(spark, files, tmp_path):
    staged = str(tmp_path / "staged")
    run_job(spark, "stage", parser().parse_args([
        "stage", "--transactions", files["transactions.csv"], "--contracts", files["contracts.csv"],
        "--blocks", files["blocks.csv"], "--out", staged,
    ]))
    out = str(tmp_path / "results")
    for job in ("time", "services", "miners"):
        run_job(spark, job, parser().parse_args([job, "--staged", staged, "--out", out, "--run-id", "s"]))
    assert json.loads(read_one(f"{out}/monthly_counts_s")) == [["01/2016", 2], ["02/2016", 4], ["12/2015", 1]]
    assert json.loads(read_one(f"{out}/top_miners_s")) == [["0xm2", 1300], ["0xm1", 540]]
    assert json.loads(read_one(f"{out}/top_services_s"))[0] == ["0xbb", 84155363699941767867374641]


def test_reports_read_one_run(spark, files, tmp_path):
    out = str(tmp_path / "results")
    common = ["--transactions", files["transactions.csv"], "--contracts", files["contracts.csv"], "--scams", files["scams.json"]]
    for run in ("a", "b"):
        for job in ("time", "services", "scams", "gas"):
            run_job(spark, job, parser().parse_args([job, *common, "--out", out, "--run-id", run]))
        run_job(spark, "miners", parser().parse_args(["miners", "--blocks", files["blocks.csv"], "--out", out, "--run-id", run]))
    reports = ["reports", "--results", out, "--out", out + "/reports", "--run-id", "r"]
    with pytest.raises(ValueError, match="2 results match"):
        run_job(spark, "reports", parser().parse_args(reports))
    run_job(spark, "reports", parser().parse_args([*reports, "--results-run-id", "b"]))

    tx, contracts, blocks = (
        read(spark, files[f])
        for read, f in ((read_transactions, "transactions.csv"), (read_contracts, "contracts.csv"), (read_blocks, "blocks.csv"))
    )
    scams = read_scams(spark, files["scams.json"])
    drop = R.REFERENCE_PANEL_DROP
    direct = {
        "count_grid": R.count_grid(Q.monthly_transaction_count(tx)),
        "average_grid": R.average_grid(Q.monthly_average_value(tx)),
        "ranked_services": R.ranked_services(Q.top_services(tx, contracts)),
        "ranked_miners": R.ranked_miners(Q.top_miners(blocks)),
        "scam_table": R.scam_table(Q.top_scams(tx, scams)),
        "scam_pivot": R.scam_pivot_exact(Q.scam_month_base(tx, scams)),
        "gas_price_panels": R.gas_price_panels(Q.monthly_gas_price(tx), drop),
        "gas_panels": R.gas_panels(Q.monthly_contract_gas(tx, contracts), drop),
    }
    for name, want in direct.items():
        got = spark.read.schema(want.schema).option("header", "true").csv(f"{out}/reports/{name}_r")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name


def test_on_bad_fail_stops_a_job(spark, files, tmp_path):
    args = ["services", "--transactions", files["transactions.csv"], "--contracts", files["contracts.csv"], "--out", str(tmp_path)]
    with pytest.raises(Exception, match="unconvertible value"):
        run_job(spark, "services", parser().parse_args([*args, "--on-bad", "fail"]))


def test_large_scam_month_table(spark, files, tmp_path):
    """Q6 beyond any size of a single document: months x scams rows, all of them."""
    months, ids = 60, 1700
    scams = {"success": True, "result": {"a": {"id": 0, "name": "n", "url": "u", "coin": "c", "category": "x", "addresses": [], "status": "s"}}}
    entry = scams["result"].pop("a")
    for k in range(ids):
        scams["result"][f"0x{k}"] = entry | {"id": k, "addresses": ["0xhit"]}
    (tmp_path / "scams.json").write_text(json.dumps(scams) + "\n")
    lines = [f"h,0,b,1,0,0xf,0xhit,{m + 1},21000,4,0x,{1450000000 + m * 2_629_800},,," for m in range(months)]
    (tmp_path / "tx.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    run_job(spark, "scams", parser().parse_args(
        ["scams", "--transactions", str(tmp_path / "tx.csv"), "--scams", str(tmp_path / "scams.json"), "--out", out, "--run-id", "x"]
    ))
    assert spark.read.json(f"{out}/scam_value_by_month_x").count() == months * ids
