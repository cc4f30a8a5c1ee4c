"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""
from __future__ import annotations

import decimal
import sys
import tempfile
import time

from . import views as V


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, decimal.Decimal):
            x = float(x) if x % 1 else int(x)
        if isinstance(x, float) and x == int(x) and abs(x) < 1e15:
            return repr(int(x))
        return repr(x)
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in V.BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = canonical([c[0] for c in rel.description], rel.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    a, b = set(got[1]), set(want[1])
    return (f"{len(got[1])} rows, expected {len(want[1])}; only here: {[r for r in got[1] if r not in b][:3]}; "
            f"only there: {[r for r in want[1] if r not in a][:3]}")


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir, names):
    from .oracle import ORACLES
    from .queries import QUERIES
    spark, con, bad = session(), duck(sf_dir), 0
    for name in names or QUERIES:
        t0 = time.time()
        try:
            diff = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) if name in ORACLES else "no SQL"
        except Exception as error:
            diff = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - t0:.1f}s {diff or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
