"""Run every registered query and compare it with its SQL on DuckDB.

    python -m workload.check [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from sightline.session import configure
from workload import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(rows: list, columns: list[str]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(r[i] for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf: str) -> str:
    q = QUERIES[name]
    df = q.run(spark, sf)
    left = normal([tuple(r) for r in df.collect()], df.columns)
    if q.sql is None:
        return f"rows {len(left[1])}"
    cursor = con.execute(q.sql)
    right = normal(cursor.fetchall(), [d[0] for d in cursor.description])
    if left[0] != right[0]:
        return f"COLUMNS {left[0]} {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"COUNT {len(left[1])} {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    if bad:
        return f"VALUES {len(bad)}/{len(left[1])} {bad[0]}"
    return f"ok {len(left[1])}"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        configure(SparkSession.builder.master("local[8]")).config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", "/tmp/sightline-check").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            result = compare(spark, con, name, sf)
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__} {str(error)[:600]}"
        bad += not result.startswith(("ok", "rows"))
        print(f"{name:32s} {time.time() - start:6.2f}s {result[:900]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
