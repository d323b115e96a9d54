"""Run queries beside their SQL twins: ``python tests/compare.py [sf_dir] [name …]``."""

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    rows = []
    for row in frame[names].itertuples(index=False, name=None):
        rows.append(tuple(None if pd.isna(v) else v for v in row))
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v).__name__ == "str"), v if v is not None else 0) for v in r))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty where both hold the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    for a, b in zip(_plain(got), _plain(want)):
        if a != b:
            return f"{a} vs {b}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    return f"note: types {kinds}" if kinds else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(sf), entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf).toPandas()
            mid = time.time()
            if name not in oracle:
                print(f"rows {name} {len(got)} spark {mid - start:.1f}s", got.head(2).to_dict("records"), flush=True)
                continue
            want = con.execute(oracle[name]).fetchdf()
            diff = difference(got, want)
            word = "OK  " if not diff else ("TYPE" if diff.startswith("note") else "DIFF")
            print(f"{word} {name} rows {len(got)} spark {mid - start:.1f}s duck {time.time() - mid:.1f}s {diff[:600]}", flush=True)
        except Exception as e:
            print(f"FAIL {name} {time.time() - start:.1f}s {type(e).__name__} {str(e)[:900]}", flush=True)
    spark.stop()
