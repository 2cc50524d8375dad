"""Run each registered query in Spark and its SQL oracle in DuckDB, compare.

Usage: ``python tests/oracle_compare.py [sf_dir] [name ...]``.  Prints one
line per query; exits non-zero if any differs.  Values are compared
exactly (doubles bit for bit), order-insensitively.
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v.normalize()) if v != 0 else "0")
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, datetime.datetime):
        return ("ts", v.isoformat())
    if isinstance(v, datetime.date):
        return ("d", v.isoformat())
    return ("s", v)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, name, make, sql, sf_dir):
    t0 = time.time()
    df = make(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    s_norm, s_cols = normalized(df.columns, s_rows)
    d_norm, d_cols_sorted = normalized(d_cols, d_rows)
    ok = s_cols == d_cols_sorted and s_norm == d_norm
    detail = ""
    if not ok:
        if s_cols != d_cols_sorted:
            detail = f"columns spark={s_cols} oracle={d_cols_sorted}"
        elif len(s_norm) != len(d_norm):
            detail = f"rows spark={len(s_norm)} oracle={len(d_norm)}"
        else:
            diffs = [(a, b) for a, b in zip(s_norm, d_norm) if a != b]
            detail = f"{len(diffs)} differing rows, first: spark={diffs[0][0]} oracle={diffs[0][1]}"
    return ok, len(s_rows), t1 - t0, detail


def main(argv):
    import __spark_entry__ as E
    from chainlens.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("CHAINLENS_TZ"):  # results must not depend on the session zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHAINLENS_TZ"])
    con = duckdb_connection(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            print(f"{name:24s} NO-ORACLE")
            continue
        try:
            ok, n, secs, detail = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as exc:  # report and continue
            ok, n, secs, detail = False, -1, 0.0, f"{type(exc).__name__}: {str(exc)[:300]}"
        bad += not ok
        print(f"{name:24s} {'OK ' if ok else 'BAD'} rows={n:<5d} {secs:6.2f}s {detail}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
