"""Run registered queries against their DuckDB oracles (like the driver's check).

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, con, sf_dir, name, q, sql):
    t0 = time.time()
    df = q(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return "rows-only", len(srows), t1 - t0, ""
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return "COLS", len(srows), t1 - t0, f"spark={sorted(scols)} duck={sorted(dcols)}"
    if len(srows) != len(drows):
        return "COUNT", len(srows), t1 - t0, f"spark={len(srows)} duck={len(drows)}"
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return "VALUES", len(srows), t1 - t0, f"{diff}"
    return "ok", len(srows), t1 - t0, ""


def main():
    args = [a for a in sys.argv[1:] if a != "--plain"]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    pats = args[1:]
    import __spark_entry__ as E
    if "--plain" in sys.argv:
        # A session as an outside harness would build it: no library defaults.
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]")
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        from veritab.session import get_spark
        spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, oracles = E.queries(), E.oracle_sql()
    bad = 0
    for name, q in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            st, n, dt, msg = compare(spark, con, sf_dir, name, q, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            st, n, dt, msg = "ERROR", -1, 0.0, repr(e)[:400]
        bad += st not in ("ok", "rows-only")
        print(f"{st:9s} {name:40s} rows={n:<7d} {dt:6.2f}s {msg}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
