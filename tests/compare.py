"""Compare registered queries with their oracle SQL: columns, row count and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return (len(got) > 0, f"{len(got)} rows (no oracle)")
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns differ: {sorted(set(cols) ^ set(df.columns))}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
    kinds = []
    for i, c in enumerate(sorted(cols)):
        ta = {type(r[i]).__name__ for r in a} - {"NoneType"}
        tb = {type(r[i]).__name__ for r in b} - {"NoneType"}
        if ta and tb and ta != tb:
            kinds.append((c, ta, tb))
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return False, f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return (not kinds and len(a) > 0), f"{len(a)} rows" + (f" TYPES {kinds}" if kinds else "")


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from wardlight.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    failed = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, note = check(spark, con, name, fn, oracles.get(name), sf)
        except Exception as ex:  # report and go on
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:900]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s  {note}", flush=True)
    print("failed:", failed)
