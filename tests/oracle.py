"""Compare queries with their SQL: rows, columns and values, in no order."""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int | bool):
        return float(f"{float(v):.9g}")
    return v


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if equal; else what differs."""
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in got_cols) for r in df.collect()), key=repr)
    cur = connect(sf_dir).execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != got_cols:
        return f"{name}: columns {got_cols} and {sorted(names)}"
    at = [names.index(c) for c in got_cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{name}: {len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b and str(a) != str(b):
            return f"{name}: {a} and {b}"
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("oriel")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    queries, sql = e.queries(), e.oracle_sql()
    for name in [n for n in queries if not sys.argv[1:] or any(n.startswith(x) for x in sys.argv[1:])]:
        t = time.time()
        try:
            if name in sql:
                said = compare(spark, name, queries[name], sql[name], sf) or "ok"
            else:
                df = queries[name](spark, sf)
                said = f"rows {df.count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{name}: FAILED {str(x)[:1500]}"
        print(f"{name:28s} {time.time() - t:6.1f} s  {said}", flush=True)
