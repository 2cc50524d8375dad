"""The streaming time analysis agrees with the batch Q1/Q2, in whatever order rows arrive."""

from __future__ import annotations

from chainlens.plans import queries as Q
from chainlens.sources.ledger import read_transactions
from chainlens.streaming.incremental import (
    monthly_time_analysis,
    read_monthly_time_analysis,
    read_transaction_stream,
    start_monthly_time_analysis,
)

from ledger_lines import TRANSACTIONS_CSV

LATE = "hz,0,b,109,0,0xf,0xzz,1,21000,4,0x,1600000000,,,"
EARLY = "hy,0,b,99,0,0xf,0xzz,3,21000,4,0x,1450000000,,,"


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    lines = TRANSACTIONS_CSV.splitlines()
    stream = monthly_time_analysis(read_transaction_stream(spark, str(src), max_files_per_trigger=1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("months_stream").start()
    # the latest month comes first, the earliest last
    for k, part in enumerate([[LATE], lines[:6], lines[6:], [EARLY]]):
        (src / f"part-{k}.csv").write_text("\n".join(part) + "\n")
        q.processAllAvailable()
    q.stop()
    got = {r.month: (r.n, r.avg_value) for r in spark.sql("SELECT * FROM months_stream").collect()}
    tx = read_transactions(spark, str(src))
    counts = dict(Q.monthly_transaction_count(tx).collect())
    avgs = dict(Q.monthly_average_value(tx).collect())
    assert got == {m: (counts[m], avgs.get(m)) for m in counts} and got["12/2015"][0] == 2


def test_files_with_checkpoint_resume(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    (src / "a.csv").write_text(TRANSACTIONS_CSV + LATE + "\n")
    start_monthly_time_analysis(spark, str(src), out, ckpt).awaitTermination()
    first = {r.month: r.n for r in read_monthly_time_analysis(spark, out).collect()}
    assert first == {"12/2015": 1, "01/2016": 2, "02/2016": 4, "09/2020": 1}
    # a restart reads the new file only, and older months still grow
    (src / "b.csv").write_text(EARLY + "\n" + EARLY + "\n")
    start_monthly_time_analysis(spark, str(src), out, ckpt).awaitTermination()
    again = {r.month: r.n for r in read_monthly_time_analysis(spark, out).collect()}
    assert again == first | {"12/2015": 3}
