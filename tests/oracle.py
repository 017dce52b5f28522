"""Side-by-side comparison of a query and its SQL; also ``python -m tests.oracle NAME... [sf]``."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

import duckdb


def connect(base: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(pathlib.Path(base).glob("*.parquet")):
        at = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{at}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def main(args):
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    from evistrata.session import local_session

    base = "/root/testdata/sf0.01"
    if args and args[-1].startswith("/"):
        base = args.pop()
    spark = local_session(int(__import__("os").environ.get("ORACLE_CORES", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls, con = e.queries(), e.oracle_sql(), connect(base)
    bad = 0
    for name in args or sorted(queries):
        began = time.time()
        try:
            cols, got = spark_rows(queries[name](spark, base))
            took = time.time() - began
            if name not in sqls:
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            names, want = duck_rows(con, sqls[name])
            same = cols == names and got == want
            bad += not same
            print(f"{name}: {'same' if same else 'DIFFERENT'} {len(got)} / {len(want)} rows, {took:.1f} s", flush=True)
            if not same:
                print("  ", cols, names)
                a, b = set(map(repr, got)), set(map(repr, want))
                print("   only Spark:", *sorted(a - b)[:4], "\n   only SQL:", *sorted(b - a)[:4], sep="\n     ")
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"{name}: ERROR {type(x).__name__} {str(x)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
