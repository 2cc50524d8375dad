"""Batch jobs: read ledger files, answer a group of questions, write results.

Each job corresponds to one analysis of the reference and writes its
results in the same shapes (a JSON array per result, or headed CSV).
Questions that share an input are answered from one pass over it:

* ``time``     Q1 + Q2 from one aggregate of the transactions;
* ``services`` Q3;            ``miners`` Q4;
* ``scams``    Q5 + Q6 from one (month, scam) aggregate; Q6 as JSON lines and as one array in many parts;
* ``gas``      Q7 and Q8;
* ``overhead`` Q9 + Q10 from one profile of the blocks table;
* ``reports``  Q11-Q18 from the result files of the other jobs;
Each job also writes ``rejects_<job>``: the rows it read and how many failed
each rule, counted in the same pass.  ``--on-bad fail`` stops at the first
value that passes the rules and can't be converted.

* ``stage``    parse transactions/contracts/blocks once into typed Parquet;
  the other jobs read it with ``--staged DIR`` instead of the text files.
"""

from __future__ import annotations

import argparse
import sys

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chainlens.functions.calendar import parse_month_text
from chainlens.operators import profile
from chainlens.operators.aggregate import integer_order
from chainlens.operators.ordering import write_ordered
from chainlens.plans import queries as Q
from chainlens.plans import reports as R
from chainlens.session import build_session, s3a_conf
from chainlens.sinks.results import (
    json_text,
    read_json_array,
    read_long_json_array,
    run_stamp,
    write_csv,
    write_json_array,
    write_rows_json,
    write_scam_months,
)
from chainlens.sources.ledger import (
    ON_BAD_CHOICES,
    read_blocks,
    read_blocks_table,
    read_contracts,
    read_transactions,
)
from chainlens.sources.scam_list import read_scams
from chainlens.sources.staging import read_staged, stage_ledger

JOBS = ("stage", "time", "services", "miners", "scams", "gas", "overhead", "reports")


def observed(df: DataFrame, *flags: str) -> tuple[DataFrame, Observation]:
    """``df`` with its rows, and the rows failing each flag, counted while the job reads them."""
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count_if(~F.coalesce(F.col(f), F.lit(False))).alias(f"not_{f}") for f in flags]
    seen = Observation()
    return df.observe(seen, *counts), seen


def result_path(spark: SparkSession, folder: str, name: str, run_id: str | None) -> str:
    """The one result ``name`` in ``folder``: of ``run_id``, or of the only run there is."""
    if run_id:
        return f"{folder}/{name}_{run_id}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}_*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    if len(found) != 1:
        raise ValueError(f"{len(found)} results match {folder}/{name}_*; name one run with --results-run-id")
    return found[0].getPath().toString()


def _month_pair(df: DataFrame, value: str, as_text: bool = False) -> list:
    v = F.col(value).cast("string") if as_text else F.col(value)
    shaped = df.select("month", v.alias(value))
    return [json_text(shaped, "month"), json_text(shaped, value)], shaped


class _Inputs:
    """Parsed inputs from text files, or from a staged folder if given."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args

    def _read(self, name: str, text_reader, text_path: str | None) -> DataFrame:
        staged = getattr(self.args, "staged", None)
        if staged:
            return read_staged(self.spark, f"{staged.rstrip('/')}/{name}")
        return text_reader(self.spark, text_path)

    def tx(self) -> DataFrame:
        return self._read("transactions", read_transactions, self.args.transactions)

    def contracts(self) -> DataFrame:
        return self._read("contracts", read_contracts, self.args.contracts)

    def blocks(self) -> DataFrame:
        return self._read("blocks", read_blocks, self.args.blocks)


def run_job(spark: SparkSession, job: str, args: argparse.Namespace) -> list[str]:
    out, stamp = args.out.rstrip("/"), args.run_id or run_stamp()
    written: list[str] = []
    inputs = _Inputs(spark, args)

    def put_json(df: DataFrame, name: str, elements, order) -> None:
        path = f"{out}/{name}_{stamp}"
        write_json_array(df, path, elements, order)
        written.append(path)

    on_bad = args.on_bad

    def put_rejects(seen: Observation) -> None:
        path = f"{out}/rejects_{job}_{stamp}"
        counts = seen.get
        write_rows_json(spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts)).coalesce(1), path)
        written.append(path)

    if job == "stage":
        raw = {k: v for k, v in (("transactions", args.transactions), ("contracts", args.contracts),
                                 ("blocks", args.blocks)) if v}
        written.extend(stage_ledger(spark, raw, out).values())
    elif job == "time":
        tx, seen = observed(inputs.tx(), "ts_digits", "value_ok")
        base = Q.monthly_base(tx, on_bad).persist(StorageLevel.MEMORY_AND_DISK)
        q1 = Q.counts_from_base(base)
        put_json(q1, "monthly_counts", [json_text(q1, "month"), json_text(q1, "n")], [F.col("month")])
        q2 = Q.averages_from_base(base).select(
            F.concat_ws(",", F.col("month"), F.col("avg_value").cast("string")).alias("row"),
            parse_month_text(F.col("month")).alias("_m"),
        )
        put_json(q2, "monthly_averages", [json_text(q2, "row")], [F.col("_m")])
        base.unpersist()
        put_rejects(seen)
    elif job == "services":
        tx, seen = observed(inputs.tx(), "block_ok", "value_wei_ok")
        # sums of any length, written as the numbers they are
        top = Q.service_totals(tx, inputs.contracts(), on_bad=on_bad)
        put_json(top, "top_services", [json_text(top, "address"), F.col("value")], [integer_order(F.col("value"), True), F.col("address")])
        put_rejects(seen)
    elif job == "miners":
        blocks, seen = observed(inputs.blocks(), "well_formed", "size_ok")
        top = Q.miner_totals(blocks, on_bad=on_bad)
        put_json(top, "top_miners", [json_text(top, "miner"), F.col("size")], [integer_order(F.col("size"), True), F.col("miner")])
        put_rejects(seen)
    elif job == "scams":
        tx, seen = observed(inputs.tx(), "value_ok")
        base = Q.scam_month_base(tx, read_scams(spark, args.scams), on_bad)
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
        top = Q.top_scams_from_base(base).withColumn("_key", F.array("id", "category"))
        put_json(top, "top_scams", [json_text(top, "_key"), json_text(top, "ether")],
                 [-F.col("ether"), F.col("id"), F.col("category")])
        # months x scams: as large as the list, so written by all tasks; as lines, and as the reference's one array
        path = f"{out}/scam_value_by_month_{stamp}"
        by_month = Q.scam_by_month_from_base(base)
        write_rows_json(by_month, path)
        written.append(path)
        path = f"{out}/ether_against_time_{stamp}"
        write_scam_months(by_month, path)
        written.append(path)
        base.unpersist()
        put_rejects(seen)
    elif job == "gas":
        tx, seen = observed(inputs.tx(), "gas_price_ok", "ts_numeric", "gas_parsed")
        els, shaped = _month_pair(Q.monthly_gas_price(tx, on_bad), "avg_gas_price", as_text=True)
        put_json(shaped, "monthly_gas_price", els, [F.col("month")])
        els, shaped = _month_pair(Q.monthly_contract_gas(inputs.tx(), inputs.contracts(), on_bad), "avg_gas", as_text=True)
        put_json(shaped, "monthly_contract_gas", els, [F.col("month")])
        put_rejects(seen)
    elif job == "overhead":
        blocks = read_blocks_table(spark, args.blocks, infer_schema=args.infer_schema)
        share = profile.column_space_share(blocks).persist(StorageLevel.MEMORY_AND_DISK)
        for name, df in (("column_space", profile.column_space_from_share(share)), ("column_space_share", share)):
            path = f"{out}/{name}_{stamp}"
            write_csv(df, path, single_file=True)
            written.append(path)
        share.unpersist()
    elif job == "reports":
        src = args.results.rstrip("/")

        def rows(name: str, kind: str = "array<string>") -> DataFrame:
            return read_json_array(spark, result_path(spark, src, name, args.results_run_id), kind)

        scam_months = result_path(spark, src, "ether_against_time", args.results_run_id)
        by_month = R.scam_months_from_rows(read_long_json_array(spark, scam_months))
        tables = {
            "count_grid": R.count_grid(R.counts_from_rows(rows("monthly_counts"))),
            "average_grid": R.average_grid(R.averages_from_rows(rows("monthly_averages", "string"))),
            "ranked_services": R.ranked_services(R.top_from_rows(rows("top_services"), "address", "value", "decimal(38,0)")),
            "ranked_miners": R.ranked_miners(R.top_from_rows(rows("top_miners"), "miner", "size", "decimal(38,0)")),
            "scam_table": R.scams_from_rows(rows("top_scams")),
            "scam_pivot": R.scam_pivot(by_month),
            "gas_price_panels": R.gas_price_panels(
                R.month_values_from_rows(rows("monthly_gas_price"), "avg_gas_price"), args.drop_years
            ),
            "gas_panels": R.gas_panels(R.month_values_from_rows(rows("monthly_contract_gas"), "avg_gas"), args.drop_years),
        }
        for name, df in tables.items():
            path = f"{out}/{name}_{stamp}"
            write_csv(df, path, single_file=True)
            written.append(path)
        path = f"{out}/scam_months_by_ether_{stamp}"
        write_ordered(by_month, path, R.ether_order(), "csv", header="true")
        written.append(path)
    else:
        raise ValueError(f"unknown job {job!r}; choose from {JOBS}")
    return written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m chainlens", description=__doc__.split("\n")[0])
    p.add_argument("job", choices=JOBS)
    p.add_argument("--transactions", help="transactions text file(s)")
    p.add_argument("--contracts", help="contracts text file(s)")
    p.add_argument("--blocks", help="blocks file(s) (text lines; headed CSV for 'overhead')")
    p.add_argument("--scams", help="scams JSON document(s)")
    p.add_argument("--results", help="folder with results of the other jobs (for 'reports')")
    p.add_argument("--staged", help="folder written by the 'stage' job; used instead of the text files")
    p.add_argument("--out", required=True, help="output folder (any Hadoop path)")
    p.add_argument("--run-id", help="suffix of result names (default: a time stamp)")
    p.add_argument("--results-run-id", help="for 'reports': the run whose results are read (needed if there are several)")
    p.add_argument("--on-bad", choices=ON_BAD_CHOICES, default="drop", help="rows whose values can't be converted")
    p.add_argument("--drop-years", type=int, nargs="*", default=list(R.REFERENCE_PANEL_DROP))
    p.add_argument("--infer-schema", action="store_true", help="infer block column types like the reference")
    p.add_argument("--s3-endpoint", help="S3-compatible endpoint for s3a:// paths")
    p.add_argument("--master", help="Spark master (default: from spark-submit)")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    conf = s3a_conf(args.s3_endpoint) if args.s3_endpoint else {}
    spark = build_session(f"chainlens-{args.job}", master=args.master, conf=conf)
    for path in run_job(spark, args.job, args):
        print(path)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
