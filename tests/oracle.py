"""Run registered queries next to their SQL and compare values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def compare(spark, name, make, sql, folder):
    t0 = time.time()
    df = make(spark, folder)
    rows = df.collect()
    t1 = time.time()
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in rows)
    if sql is None:
        return f"rows-only rows={len(rows)}", t1 - t0, len(rows) > 0
    cur = connect(folder).execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"COLUMNS {cols} != {sorted(names)}", t1 - t0, False
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return f"ok rows={len(got)} sql={time.time()-t1:.1f}", t1 - t0, bool(got)
    a, b = set(got) - set(want), set(want) - set(got)
    return f"DIFF rows {len(got)}/{len(want)} {cols} spark={sorted(a)[:3]} sql={sorted(b)[:3]}"[:900], t1 - t0, False


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from incidentkit.session import local_session

    folder = f"/root/testdata/{sys.argv[1]}"
    picked = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    bad = 0
    for name, make in entry.queries().items():
        if picked and not any(name.startswith(p) for p in picked):
            continue
        try:
            text, secs, fine = compare(spark, name, make, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            text, secs, fine = f"ERROR {type(e).__name__} {str(e)[:700]}", 0.0, False
        bad += not fine
        print(f"{'  ' if fine else '!!'} {name} {secs:.1f}s {text}", flush=True)
    print("bad:", bad)
