"""Scale rehearsal: skewed, multiplied transactions; per-stage task spread.

    python tools/skew_rehearsal.py [SF_DIR] [COPIES]

Builds (once per run, in a fresh scratch folder) ``COPIES`` copies of the
transaction lines derived from ``SF_DIR`` where a third of the lines are
redirected to one address that is both a contract and a scam address, runs
Q1-Q8 (Q5 and Q8 also with broadcasts disabled, i.e. their shuffle paths)
with Spark's event log on, and prints for every stage its task count and
the slowest / median task time and whether it scans input or reads a
shuffle.  A hot key that a plan failed to absorb shows up in a
shuffle-reading stage as a slowest task far above the median (in scan
stages the spread follows the input files' sizes instead).
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from chainlens.plans import queries as Q  # noqa: E402
from chainlens.session import build_session  # noqa: E402
from chainlens.sources import star  # noqa: E402
from chainlens.sources.ledger import parse_contracts, parse_transactions  # noqa: E402
from chainlens.sources.scam_list import parse_scams  # noqa: E402

HOT = "0xs0"


def skewed_lines(spark, sf_dir: str, copies: int):
    lines = star.transaction_lines(spark, sf_dir)
    f = F.split("value", ",", -1)
    parts = []
    for k in range(copies):
        hot = (F.abs(F.hash("value", F.lit(k))) % 3 == 0) & (F.size(f) == 15)
        moved = F.concat_ws(",", F.slice(f, 1, 6), F.array(F.lit(HOT)), F.slice(f, 8, 8))
        parts.append(lines.select(F.when(hot, moved).otherwise(F.col("value")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stage_spread(event_dir: str) -> None:
    import zstandard

    stage_group, tasks = {}, defaultdict(list)
    input_rows, shuffle_rows = defaultdict(int), defaultdict(int)
    for path in sorted(glob.glob(f"{event_dir}/*/events_*") + glob.glob(f"{event_dir}/*.zstd")):
        raw = open(path, "rb")
        stream = (
            io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
            if path.endswith(".zstd")
            else io.TextIOWrapper(raw, encoding="utf-8")
        )
        for line in stream:
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                for s in e["Stage IDs"]:
                    stage_group[s] = e.get("Properties", {}).get("spark.jobGroup.id", "?")
            elif e["Event"] == "SparkListenerTaskEnd":
                info, metrics = e["Task Info"], e.get("Task Metrics") or {}
                tasks[e["Stage ID"]].append(info["Finish Time"] - info["Launch Time"])
                input_rows[e["Stage ID"]] += (metrics.get("Input Metrics") or {}).get("Records Read", 0)
                shuffle_rows[e["Stage ID"]] += (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
    for s in sorted(tasks):
        d = tasks[s]
        if max(d) < 200:
            continue
        kind = f"shuffle-read {shuffle_rows[s]:>9d} rows" if shuffle_rows[s] else f"scan {input_rows[s]:>9d} rows"
        print(f"{stage_group.get(s, '?'):12s} stage {s:4d} tasks {len(d):4d} "
              f"max {max(d):7d} ms  median {int(statistics.median(d)):7d} ms  {kind}")  # fmt: skip


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    events = f"{scratch}/events"
    os.makedirs(events)
    spark = build_session(
        "skew-rehearsal",
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "64", "spark.eventLog.enabled": "true",
              "spark.eventLog.dir": f"file://{events}"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    skewed_lines(spark, sf_dir, copies).write.text(f"{scratch}/tx")
    tx = parse_transactions(spark.read.text(f"{scratch}/tx"))
    contracts = parse_contracts(star.contract_lines(spark, sf_dir))
    scams = parse_scams(star.scam_lines(spark, sf_dir))
    runs = {
        "q1": lambda: Q.monthly_transaction_count(tx),
        "q2": lambda: Q.monthly_average_value(tx),
        "q3": lambda: Q.top_services(tx, contracts),
        "q5": lambda: Q.top_scams(tx, scams),
        "q5_shuffle": lambda: Q.top_scams(tx, scams, max_broadcast_bytes=0),
        "q7": lambda: Q.monthly_gas_price(tx),
        "q8": lambda: Q.monthly_contract_gas(tx, contracts),
        "q8_shuffle": lambda: Q.monthly_contract_gas(tx, contracts, max_broadcast_bytes=0),
    }
    for name, make in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        start = time.time()
        n = len(make().collect())
        print(f"{name:12s} {time.time() - start:7.2f} s  rows={n}", flush=True)
    spark.stop()
    stage_spread(events)
    print(f"scratch folder: {scratch}")


if __name__ == "__main__":
    main()
