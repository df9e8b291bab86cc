"""Runs queries beside their SQL: python tests/harness.py [folder] [name...]"""

import datetime
import math
import os
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def views(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf, name, f, sql):
    df = f(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    kinds = dict(df.dtypes)
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return f"{len(got[1])} and {len(want[1])} rows; only here {[r for r in got[1] if repr(r) not in b][:2]}, only SQL {[r for r in want[1] if repr(r) not in a][:2]} {kinds}"


def main(args):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = views(sf), 0
    for name, f in e.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        t = time.time()
        try:
            sql = e.oracle_sql().get(name)
            r = compare(spark, con, sf, name, f, sql) if sql else f"rows only: {f(spark, sf).count()}"
        except Exception:
            r = "ERROR " + traceback.format_exc()[-700:]
        bad += bool(r) and not r.startswith("rows only")
        print(name, f"{time.time() - t:.1f}s", r or "ok", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
