"""Run registered queries on Spark and their SQL on DuckDB and compare whole results.

usage: python tools/compare.py [--sf DIR] [name ...]      names may be prefixes ending in *
"""

from __future__ import annotations

import argparse
import datetime as dt
import fnmatch
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if isinstance(v, (str, dt.date)) else str(v)


def by_name(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(r[i] for i in order) for r in rows]


def strict(v):
    """The value as it is, numbers as floats."""
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", type=int, default=3)
    args = ap.parse_args()
    import duckdb
    from tapeloom.session import build_session
    from tapeloom.suite import load_all
    queries, oracle = load_all()
    pats = args.names or ["*"]
    names = [q for q in queries if any(fnmatch.fnmatch(q, p) for p in pats)]
    spark = build_session("compare", "local[8]", 8, **{"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                       "spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, args.sf)
            got = df.collect()
            cols, rows = rows_of(df.columns, got)
        except Exception as exc:  # noqa: BLE001
            print(f"ERROR  {name}: {str(exc)[:1500]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in oracle:
            print(f"rows   {name}: {len(rows)} rows {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(oracle[name])
            want, names_ = cur.fetchall(), [d[0] for d in cur.description]
            dcols, drows = rows_of(names_, want)
            raw = (by_name(df.columns, got), by_name(names_, want))
        except Exception as exc:  # noqa: BLE001
            print(f"SQLERR {name}: {str(exc)[:1500]}")
            bad += 1
            continue
        t2 = time.time()
        if cols != dcols:
            print(f"COLS   {name}: {cols} vs {dcols}")
            bad += 1
        elif rows != drows:
            bad += 1
            s, d = set(rows), set(drows)
            print(f"DIFF   {name}: {len(rows)} vs {len(drows)} rows; cols {cols}")
            for r in [r for r in rows if r not in d][:args.show]:
                print("   spark", r)
            for r in [r for r in drows if r not in s][:args.show]:
                print("   duck ", r)
        else:
            exact = len(Counter(map(tuple, (map(strict, r) for r in raw[0]))) - Counter(map(tuple, (map(strict, r) for r in raw[1]))))
            nul = [c for i, c in enumerate(cols) if rows and all(r[i] is None for r in rows)]
            print(f"ok     {name}: {len(rows)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
                  + (f" ALL-NULL {nul}" if nul else "") + (f" NOT-EXACT {exact}" if exact else ""), flush=True)
    print(f"{bad} bad of {len(names)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
