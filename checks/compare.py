"""Run registered queries on Spark and DuckDB and compare rows. Usage: compare.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(values, order):
    def norm(x):
        return f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(norm(v[i]) for i in order) for v in values)


def compare(spark, con, sf, run, sql):
    df = run(spark, sf)
    got = df.collect()
    if sql is None:
        return None, len(got), 0, ""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, len(got), len(want), f"columns {sorted(df.columns)} vs {sorted(cols)}"
    names = sorted(cols)
    a, b = rows(got, [df.columns.index(c) for c in names]), rows(want, [cols.index(c) for c in names])
    if a == b:
        return True, len(a), len(b), ""
    from collections import Counter
    x, y = Counter(a), Counter(b)
    return False, len(a), len(b), (f"{names}\n   spark {list((x - y))[:4]}\n   duck  {list((y - x))[:4]}")[:1800]


def main():
    from checks.queries import ORACLES, QUERIES
    sf, only = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf)
    bad = 0
    for name, run in QUERIES.items():
        if only and not any(name.startswith(p) for p in only):
            continue
        start = time.time()
        try:
            ok, n, m, note = compare(spark, con, sf, run, ORACLES.get(name))
        except Exception as e:  # report and go on with the next query
            ok, n, m, note = False, 0, 0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += ok is False
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'BAD '} {name} {n} {m} {time.time() - start:.1f}s {note}", flush=True)
    print("bad:", bad, "of", len(QUERIES))


if __name__ == "__main__":
    main()
