"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Comparison: same row count, same column names (sorted), and equal multisets
of rows after rounding floats to 6 decimals (exact hash) -- also reports a
relative-tolerance match for diagnosis.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    from decimal import Decimal
    if isinstance(v, Decimal):
        return repr(round(float(v), 6) + 0.0)
    return repr(v)


def row_hash(cols, row):
    return hashlib.md5("|".join(norm(row[c]) for c in cols).encode()).hexdigest()


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    problems = []
    if sorted(spark_cols) != sorted(duck_cols):
        problems.append(f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}")
        return problems
    cols = sorted(spark_cols)
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} vs {len(duck_rows)}")
    a = sorted(row_hash(cols, r) for r in spark_rows)
    b = sorted(row_hash(cols, r) for r in duck_rows)
    if a != b:
        sa, sb = set(a), set(b)
        problems.append(f"hash mismatch: {len(sa - sb)} spark-only, {len(sb - sa)} duck-only")
    return problems


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    from tessera.session import build_session
    spark = build_session(int(os.environ.get("ORACLE_CPUS", "8")))
    qs, oracles = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = [r.asDict() for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracles:
            print(f"{name:28s} rows={len(rows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(oracles[name])
            dcols = [d[0] for d in cur.description]
            drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCKDB ERROR {str(e)[:300]}")
            bad += 1
            continue
        probs = compare(rows, cols, drows, dcols)
        status = "OK" if not probs else "FAIL " + "; ".join(probs)
        bad += bool(probs)
        print(f"{name:28s} rows={len(rows):7d} {ts:5.1f}s {status}")
    print("failures:", bad)


if __name__ == "__main__":
    main()
