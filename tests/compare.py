"""Run queries and their SQL side by side and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(folder, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def compare(spark, name, query, sql, folder):
    got_names, got = spark_rows(query(spark, folder))
    if sql is None:
        return len(got), None
    want_names, want = duck_rows(folder, sql)
    if got_names != want_names:
        return len(got), f"columns {got_names} / {want_names}"
    if got != want:
        only = [r for r in got if r not in set(want)][:2]
        miss = [r for r in want if r not in set(got)][:2]
        return len(got), f"{len(got)} / {len(want)} rows\n   spark only {only}\n   sql only   {miss}"
    return len(got), None


def main(argv):
    import __spark_entry__ as entry
    from offerlens.session import build_session

    folder = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                     "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    oracle = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            rows, problem = compare(spark, name, query, oracle.get(name), folder)
        except Exception as e:
            rows, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        note = "no sql" if name not in oracle else ""
        print(f"{'ok ' if not problem else 'BAD'} {name:32s} {rows:8d} rows {time.time() - start:6.2f}s {note} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
