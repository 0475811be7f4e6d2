"""Compare registered queries with their SQL on the same tables.

Usage: python tests/oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session():
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master("local[8]").appName("etlvault-tests")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.warehouse.dir", f"/tmp/etlvault-warehouse-{os.getpid()}")
            .getOrCreate())


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, type(v).__name__, str(v)) for v in row)


def compare(df, con, sql) -> str:
    """Empty string when equal, else a description of the first differences."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    want = [tuple(r[i] for i in at) for r in want]
    if len(got) != len(want):
        detail = f"rows {len(got)} != {len(want)}"
    else:
        detail = ""
    got, want = sorted(got, key=_key), sorted(want, key=_key)
    if got == want and [_key(r) for r in got] == [_key(r) for r in want]:
        return ""
    sg, sw = set(map(_key, got)), set(map(_key, want))
    only_g = [r for r in got if _key(r) not in sw][:3]
    only_w = [r for r in want if _key(r) not in sg][:3]
    return f"{detail} {order}\n   spark only: {only_g}\n   sql only:   {only_w}"


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    sf = argv[0] if argv else "0.01"
    prefixes = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                message = compare(df, con, sql[name])
            else:
                message = "" if df.collect() else "no rows"
        except Exception as e:
            message = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(message)
        mark = "FAIL" if message else ("ok" if name in sql else "ok (rows only)")
        print(f"{mark:15s} {name:32s} {time.time() - t:6.2f}s {message}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
