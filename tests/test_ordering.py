"""A stored order (T8), and the pivot that reads its input once."""

from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from chainlens.operators.calendar_grid import category_pivot
from chainlens.operators.ordering import numbered, read_numbered, write_ordered
from chainlens.plans import queries as Q
from chainlens.plans import reports as R
from chainlens.plans.catalog import LedgerInputs
from chainlens.sources.ledger import read_transactions
from chainlens.sources.scam_list import read_scams
from ledger_lines import TRANSACTIONS_CSV, plan_text

TYPES = "month string, id string, category string, ether double"


def months(n, seed=1):
    rng = random.Random(seed)
    rows = [(f"{k % 12 + 1:02d}/2016", str(rng.randrange(40)), rng.choice("ab"), rng.choice([0.5, 7.0, 7.0, 1e25, float(k)])) for k in range(n)]
    return rows + [("01/2017", None, "a", None), (None, "3", None, 2.0), *[rows[0]] * (n > 0) * 3]


def in_order(rows):
    low = lambda v: (v is not None, v or "")
    return sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0.0), low(r[0]), low(r[1]), low(r[2])))


@pytest.mark.parametrize("n", [0, 1, 900])
def test_numbers_are_the_order(spark, n):
    rows = months(n) if n else []
    df = spark.createDataFrame(rows, TYPES).repartition(5)
    got = sorted(tuple(r) for r in R.scam_months_by_ether(df).collect())
    assert [r[0] for r in got] == list(range(1, len(rows) + 1))
    assert [r[1:] for r in got] == in_order(rows)


def test_files_hold_the_order(spark, tmp_path):
    rows = [r for r in months(400) if None not in r]
    df = spark.createDataFrame(rows, TYPES).repartition(3)
    write_ordered(df, f"{tmp_path}/csv", R.ether_order(), "csv", partitions=6, header="true")
    files = sorted(glob.glob(f"{tmp_path}/csv/part-*.csv"))
    assert len(files) > 1
    lines = [ln.strip().split(",") for f in files for ln in open(f).readlines()[1:]]
    assert [(m, i, c, float(e)) for m, i, c, e in lines] == in_order(rows)
    write_ordered(df, f"{tmp_path}/rows", R.ether_order(), partitions=6)
    # however the reader splits and orders the files
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted(tuple(r) for r in read_numbered(spark, f"{tmp_path}/rows").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[1:] for r in got] == in_order(rows)


def test_other_columns_and_a_name_of_choice(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, None)], "_n long, _file string")
    got = sorted(tuple(r) for r in numbered(df, [F.col("_n")], "at").collect())
    assert got == [(1, 1, "y"), (2, 2, None), (3, 3, "x")]


def jobs_of(spark, run):
    """Jobs that ``run`` starts, and the task counts of the stages that ran in them."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs if (info := tracker.getJobInfo(j)) for s in info.stageIds}
    ran = [info.numTasks for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks]
    return len(jobs), ran


def test_the_pivot_reads_transactions_once(spark, files, tmp_path):
    """The only stages with a task for each of 13 transaction files: one in Q6, one in Q16."""
    folder = tmp_path / "tx"
    folder.mkdir()
    for k in range(13):
        (folder / f"{k}.csv").write_text(TRANSACTIONS_CSV)
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 20))
    try:
        def q6():
            tx, scams = read_transactions(spark, str(folder)), read_scams(spark, files["scams.json"])
            return Q.scam_value_by_month(tx, scams).collect()

        def q16():
            tx, scams = read_transactions(spark, str(folder)), read_scams(spark, files["scams.json"])
            pivot = R.scam_pivot_exact(Q.scam_month_base(tx, scams))
            assert "tx" not in [ln for ln in plan_text(pivot).splitlines() if ln.startswith("Location")][0].split("/")
            return pivot.collect()

        assert jobs_of(spark, q6)[1].count(13) == 1
        jobs, stages = jobs_of(spark, q16)
        assert stages.count(13) == 1, (jobs, stages)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pivot_columns(spark):
    cells = spark.createDataFrame([("01/2016", "b", 1.0), ("01/2016", "a", 2.0), ("01/2016", "a", 3.0), ("02/2016", "c, d", None)], "month string, category string, ether double")
    found = category_pivot(cells, "ether")
    assert found.columns == ["year", "month", "a", "b", "c, d"]
    assert [tuple(r) for r in found.collect()] == [(2016, 1, 5.0, 1.0, None), (2016, 2, None, None, None)]
    given = category_pivot(cells, "ether", ["b", "z"])
    assert [tuple(r) for r in given.collect()] == [(2016, 1, 1.0, None), (2016, 2, None, None)]
    none = category_pivot(cells.limit(0), "ether")
    assert none.columns == ["year", "month"] and none.count() == 0
    blank = category_pivot(cells.withColumn("category", F.lit(None).cast("string")), "ether")
    assert blank.columns == ["year", "month", "null"] and blank.first()["null"] == 6.0


def test_whole_result_at_a_table_s_size(spark):
    inputs = LedgerInputs(spark, "/root/testdata/sf0.001")
    by_month = Q.scam_value_by_month(inputs.tx, inputs.scams)
    got = sorted(tuple(r) for r in R.scam_months_by_ether(by_month).collect())
    assert [r[1:] for r in got] == in_order([tuple(r) for r in by_month.collect()])
