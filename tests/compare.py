"""Run queries beside their check SQL: python tests/compare.py [sf] [key ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, tuple) else (True, "t", str(v)) for v in r))


def differences(spark_df, con, sql) -> str:
    """Empty when both sides agree in columns, types of value and rows."""
    cur = con.execute(sql)
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows vs {len(theirs[1])}; {ours[1][:2]} vs {theirs[1][:2]}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b or any(type(x) is not type(y) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(ours[1])} rows differ in {ours[0]}, e.g. {bad[0]}" if bad else ""


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("pollmill").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main(argv):
    import __spark_entry__ as entry
    sf = f"/root/testdata/sf{argv[0] if argv else '0.001'}"
    wanted = argv[1:]
    spark, con = session(), connect(sf)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, fn in queries.items():
        if wanted and key not in wanted and not any(w.endswith("*") and key.startswith(w[:-1]) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if key in checks:
                msg = differences(df, con, checks[key])
            else:
                rows = df.collect()
                msg = "" if rows else "no rows"
                if wanted:
                    print("   ", df.columns, rows[:4])
        except Exception as e:
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(msg)
        print(f"{'BAD' if msg else 'ok '} {key:28s} {time.time() - t:6.1f}s {'checked' if key in checks else 'rows only'} {msg[:1500]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
