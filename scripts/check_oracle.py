"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python scripts/check_oracle.py [--sf DIR] [name ...]
Compares row count, column names and an order-insensitive hash of values
(type-aware: an int and a float never compare equal).  Prints one line per
query and a JSON summary at the end.
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from postsignal.registry import all_queries  # noqa: E402
from postsignal.sources.fixtures import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "N"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "fnan"
        return f"f{v!r}"
    if isinstance(v, decimal.Decimal):
        return f"d{v}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return f"t{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return f"s{v}"


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from postsignal.session import local_session
    spark = local_session(8, 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    qs = all_queries()
    names = a.names or list(qs)
    summary = {}
    for n in names:
        q = qs[n]
        t0 = time.time()
        try:
            df = q.fn(spark, a.sf)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            summary[n] = "spark-error"
            continue
        dt = time.time() - t0
        if not q.sql:
            print(f"{n:28s} rows-only  rows={len(s_rows)}  {dt:.1f}s")
            summary[n] = "rows-only"
            continue
        try:
            res = con.execute(q.sql)
            d_cols = [c[0] for c in res.description]
            d_rows = [tuple(r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            summary[n] = "duck-error"
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        hs, ls = digest(s_cols, s_rows)
        hd, ld = digest(d_cols, d_rows)
        status = "MATCH" if (ok_cols and hs == hd) else "DIFF"
        print(f"{n:28s} {status:6s} rows={len(s_rows)}/{len(d_rows)} cols={'ok' if ok_cols else 'DIFF'} {dt:.1f}s")
        if status != "MATCH":
            if not ok_cols:
                print("   spark:", s_cols, "\n   duck: ", d_cols)
            only_s = sorted(set(ls) - set(ld))[:3]
            only_d = sorted(set(ld) - set(ls))[:3]
            for x in only_s:
                print("   spark-only:", x[:300])
            for x in only_d:
                print("   duck-only: ", x[:300])
        summary[n] = status.lower()
    print(json.dumps(summary))


if __name__ == "__main__":
    main()
