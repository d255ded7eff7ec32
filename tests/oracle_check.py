"""Run every registered query on Spark and its SQL on DuckDB, and compare. Usage: oracle_check.py [sf_dir] [name part]."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    """ORACLE_NO_BROADCAST=1 makes every join a shuffle join, as joins of large tables are."""
    threshold = "-1" if os.environ.get("ORACLE_NO_BROADCAST") else "10MB"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.autoBroadcastJoinThreshold", threshold)
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return value + 0.0 if isinstance(value, float) else value

    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(name: str, spark_rows: tuple, duck_rows: tuple) -> str:
    (spark_columns, mine), (duck_columns, theirs) = spark_rows, duck_rows
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns differ: {sorted(spark_columns)} / {sorted(duck_columns)}"
    mine, theirs = rows_of(spark_columns, mine), rows_of(duck_columns, theirs)
    if mine == theirs:
        return "ok" if mine else "ok (empty)"
    left, right = set(mine), set(theirs)
    only_left, only_right = sorted(left - right, key=repr)[:2], sorted(right - left, key=repr)[:2]
    return f"{len(mine)} / {len(theirs)} rows, {len(left - right)} differ\n   {sorted(spark_columns)}\n   spark {only_left}\n   duck  {only_right}"


def main() -> int:
    import __spark_entry__ as contract

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2] if len(sys.argv) > 2 else ""
    spark, con = session(), connect(sf_dir)
    oracle = contract.oracle_sql()
    failed = []
    for name, run in contract.queries().items():
        if wanted not in name:
            continue
        try:
            started = time.time()
            df = run(spark, sf_dir)
            mine = (df.columns, [tuple(row) for row in df.collect()])
            spark_seconds, started = time.time() - started, time.time()
            if name in oracle:
                cursor = con.execute(oracle[name])
                theirs = ([d[0] for d in cursor.description], cursor.fetchall())
                verdict = compare(name, mine, theirs)
            else:
                verdict = f"rows only: {len(mine[1])}"
            print(f"{name:28s} {len(mine[1]):7d} rows {spark_seconds:6.2f}s {time.time() - started:6.2f}s  {verdict}", flush=True)
            if not verdict.startswith(("ok", "rows only")):
                failed.append(name)
        except Exception as error:  # report and go on to the next query
            print(f"{name:28s} FAILED {str(error)[:1500]}", flush=True)
            failed.append(name)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
