"""Benchmark: every query on the production path, at one scale factor.

Setup (not timed): the ledger inputs are derived from the tables in
``$BENCH_SF_DIR`` and written as files - text lines, headed CSV and JSON
lines - under the session's ``spark.checkpoint.dir`` (a fresh temporary
folder if unset).  Files from an earlier run of the same code are reused;
otherwise a new folder is taken, nothing is overwritten.

Timed, per query: build the plan, read the files through the readers, run
to completion (``collect`` of the small result).  Each query runs once to
warm the JVM, then ``BENCH_RUNS`` (default 2) timed runs; the fastest
counts.  ``value`` is the sum over the headline queries on the text path (what
the reference reads); ``further_queries`` are timed the same way.  ``staged_*`` repeats the suite after the transactions,
contracts and blocks were parsed once into typed Parquet.  ``jobs`` times
the seven batch jobs once each (text inputs, results written to scratch).

Prints one JSON line.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
import sys
import tempfile
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chainlens.plans.catalog import FileInputs, StagedInputs, build  # noqa: E402
from chainlens.session import build_session  # noqa: E402
from chainlens.sources import star  # noqa: E402
from chainlens.sources.staging import stage_ledger  # noqa: E402

#: The suite whose sum is ``value``, the same in every round; other queries are timed beside it.
HEADLINE = (
    "q1_monthly_count", "q2_monthly_avg_value", "q3_top_services", "q4_top_miners", "q5_top_scams", "q6_scam_by_month",
    "q7_monthly_gas_price", "q8_contract_gas", "q9_column_space", "q10_space_share", "q11_count_grid", "q12_avg_grid",
    "q13_ranked_services", "q14_ranked_miners", "q15_scam_table", "q16_scam_pivot", "q17_gas_price_panels", "q18_gas_panels",
    "rules_transactions", "rules_contracts", "rules_blocks", "scam_rows",
)

HERE = os.path.dirname(os.path.abspath(__file__))


def _code_tag() -> str:
    h = hashlib.sha1()
    for rel in ("chainlens/sources/star.py", "chainlens/sources/ledger.py", "chainlens/sources/staging.py",
                "chainlens/functions/parse.py", "chainlens/functions/calendar.py", "chainlens/operators/aggregate.py"):
        with open(os.path.join(HERE, rel), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:10]


def _complete(paths: dict[str, str]) -> bool:
    return all(os.path.exists(os.path.join(p, "_SUCCESS")) for p in paths.values())


def _folder(scratch: str, prefix: str) -> str:
    existing = sorted(glob.glob(f"{scratch}/{prefix}-*"))
    return existing[-1] if existing else f"{scratch}/{prefix}-{uuid.uuid4().hex[:8]}"


def time_suite(queries, names, runs):
    for name in names:
        queries[name]().collect()  # warm-up
    timings, rows = {}, {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.time()
            result = queries[name]().collect()
            best = min(best, time.time() - start)
        timings[name] = round(best, 3)
        rows[name] = len(result)
    return timings, rows


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        "chainlens-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    scratch = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="chainlens-bench-")
    scratch = scratch.removeprefix("file:")
    prefix = f"ledger-{re.sub(r'[^A-Za-z0-9_.-]', '_', sf_dir)}-{_code_tag()}"
    base = _folder(scratch, prefix)
    names = ("transactions", "contracts", "blocks", "blocks_csv", "scams", "scams_document", "wide_transactions", "wide_blocks")
    paths = {n: f"{base}/{n}" for n in names}
    t0 = time.time()
    if not _complete(paths):
        base = f"{scratch}/{prefix}-{uuid.uuid4().hex[:8]}"
        paths = star.write_ledger_files(spark, sf_dir, base)
    setup = time.time() - t0

    input_rows = {n: spark.read.text(paths[n]).count() for n in ("transactions", "contracts", "blocks", "scams")}

    queries = build(FileInputs(spark, paths))
    selected = [n for n in HEADLINE if not only or n in only]
    timings, rows = time_suite(queries, selected, runs)
    further, _ = time_suite(queries, [n for n in queries if n not in HEADLINE and (not only or n in only)], runs)

    # Optional sections below never suppress the headline line: an error is
    # recorded in the output instead.
    errors: dict[str, str] = {}
    staged_timings, staged_rows, stage_secs = {}, {}, 0.0
    try:
        t0 = time.time()
        staged_base = _folder(base, "staged")
        staged = {n: f"{staged_base}/{n}" for n in ("transactions", "contracts", "blocks")}
        if not _complete(staged):
            staged = stage_ledger(spark, {n: paths[n] for n in staged}, f"{base}/staged-{uuid.uuid4().hex[:8]}")
        stage_secs = time.time() - t0
        staged_timings, staged_rows = time_suite(build(StagedInputs(spark, paths, staged)), selected, runs)
    except Exception as exc:  # noqa: BLE001
        errors["staged"] = f"{type(exc).__name__}: {str(exc)[:300]}"

    # The batch jobs: the same questions grouped as a user runs them, with
    # shared scans (Q1+Q2, Q5+Q6, Q7+Q8, Q9+Q10 each from one pass).
    from chainlens.jobs import parser, run_job

    results = f"{base}/results-{uuid.uuid4().hex[:8]}"
    job_args = {
        "time": ["--transactions", paths["transactions"]],
        "services": ["--transactions", paths["transactions"], "--contracts", paths["contracts"]],
        "miners": ["--blocks", paths["blocks"]],
        "scams": ["--transactions", paths["transactions"], "--scams", paths["scams"]],
        "gas": ["--transactions", paths["transactions"], "--contracts", paths["contracts"]],
        "overhead": ["--blocks", paths["blocks_csv"]],
        "reports": ["--results", results, "--drop-years", "2001"],
    }
    job_timings = {}
    try:
        for job, extra in job_args.items():
            start = time.time()
            out_dir = results if job != "reports" else results + "/reports"
            run_job(spark, job, parser().parse_args([job, *extra, "--out", out_dir, "--run-id", "bench"]))
            job_timings[job] = round(time.time() - start, 3)
    except Exception as exc:  # noqa: BLE001
        errors["jobs"] = f"{type(exc).__name__}: {str(exc)[:300]}"
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "further_queries": further,
        "rows": rows,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
        "staged_value": round(sum(staged_timings.values()), 3),
        "staged_queries": staged_timings,
        "staged_rows_match": staged_rows == rows,
        "errors": errors,
        "input_lines": input_rows,
        "q1_lines_per_sec": round(input_rows["transactions"] / timings["q1_monthly_count"])
        if "q1_monthly_count" in timings
        else None,
        "jobs_total": round(sum(job_timings.values()), 3),
        "jobs": job_timings,
        "setup_write_files_sec": round(setup, 3),
        "setup_stage_parquet_sec": round(stage_secs, 3),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
