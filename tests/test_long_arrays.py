"""JSON arrays of any size (S9, S12, N6): written and read by many tasks, one document all the same."""

from __future__ import annotations

import glob
import json

import pytest
from pyspark.sql import functions as F

from chainlens.plans import reports as R
from chainlens.sinks.results import json_text, read_json_array, read_long_json_array, write_long_json_array, write_scam_months

ROWS = [
    (f"{k % 12 + 1:02d}/20{k % 30 + 10}", str(k), c, e)
    for k in range(300)
    for c, e in (("Scamming", 0.1 * k), ('a "quoted, [bracketed]\nname', 1e25 + k), ("", None))
]
TYPES = "month string, id string, category string, ether double"


def document(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_parts_are_one_document_in_order(spark, tmp_path):
    df = spark.createDataFrame(ROWS, TYPES).repartition(6)
    write_scam_months(df, f"{tmp_path}/q6")
    assert len([f for f in glob.glob(f"{tmp_path}/q6/part-*") if open(f).read()]) > 4
    got = json.loads(document(f"{tmp_path}/q6"))
    want = sorted(ROWS, key=lambda r: (r[0][3:], r[0][:2], r[1], r[2]))
    assert got == [[[m, [i, c]], e] for m, i, c, e in want]


def test_several_tasks_read_it_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, TYPES)
    write_scam_months(df, f"{tmp_path}/q6")
    # one large file, as a user may have joined the parts
    (tmp_path / "joined").mkdir()
    (tmp_path / "joined" / "a.txt").write_text(document(f"{tmp_path}/q6"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        for path in (f"{tmp_path}/q6", f"{tmp_path}/joined"):
            rows = read_long_json_array(spark, path)
            assert rows.rdd.getNumPartitions() > 5
            key = lambda r: tuple(map(repr, r))
            assert sorted(map(tuple, R.scam_months_from_rows(rows).collect()), key=key) == sorted(ROWS, key=key)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # the reader of one-line documents takes it as well
    assert read_json_array(spark, f"{tmp_path}/joined").count() == len(ROWS)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, tmp_path, n):
    df = spark.range(n).select((F.col("id") * 10).alias("v"))
    write_long_json_array(df, f"{tmp_path}/a", [json_text(df, "v")], [-F.col("v")])
    assert json.loads(document(f"{tmp_path}/a")) == [10 * k for k in reversed(range(n))]
    got = [r.item for r in read_long_json_array(spark, f"{tmp_path}/a", "bigint").collect()]
    assert sorted(got) == [10 * k for k in range(n)]


def test_ties_and_repeated_rows_all_stay(spark, tmp_path):
    df = spark.createDataFrame([("x", None)] * 50 + [("x", 1)] * 3, "a string, b int").repartition(4)
    write_long_json_array(df, f"{tmp_path}/a", [json_text(df, "a"), json_text(df, "b")], [F.col("a")])
    assert sorted(json.loads(document(f"{tmp_path}/a")), key=str) == [["x", 1]] * 3 + [["x", None]] * 50


def test_a_broken_line_stops_the_job(spark, tmp_path):
    (tmp_path / "a.txt").write_text('[["a", 1]\n, ["b", 2\n]\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_long_json_array(spark, str(tmp_path / "a.txt")).collect()
