"""Run registered queries and their SQL twins on the same tables and compare rows.

As a script: ``python tests/compare.py <folder> [name ...]``.
"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}" if float(v) else "0"
    return str(v)


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


def differences(spark, con, folder, build, sql):
    df = build(spark, folder)
    mine = rows_of([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if not mine:
        return "no rows"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    from panelkit.queries import QUERIES, SQL

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    con = oracle(folder)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            if name in SQL:
                result = differences(spark, con, folder, QUERIES[name], SQL[name])
            else:
                result = None if QUERIES[name](spark, folder).collect() else "no rows"
        except Exception as e:  # report and go on
            result = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok ' if result is None else 'BAD'} {time.time() - start:6.2f} {name} {result or ''}", flush=True)
