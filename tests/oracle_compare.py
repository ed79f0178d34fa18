"""Run registered queries next to their SQL on DuckDB and report differences.

Usage: python tests/oracle_compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        rows.append(tuple(
            "" if value is None or (not isinstance(value, list) and pd.isna(value))
            else round(value, 5) if isinstance(value, float) else str(value)
            for value in row))
    return sorted(rows, key=str)


def compare(spark, connection, build, sql: str, sf_dir: str) -> str | None:
    """None when both results agree, else what differs."""
    ours = build(spark, sf_dir).toPandas()
    theirs = connection.execute(sql).fetchdf()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    # Integer columns with NULLs become floats in pandas; compare both as numbers.
    for name in ours.columns:
        if {ours[name].dtype.kind, theirs[name].dtype.kind} & {"f"}:
            ours[name] = ours[name].astype(float)
            theirs[name] = theirs[name].astype(float)
    left, right = canonical(ours), canonical(theirs)
    if left == right:
        return None
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    first = next((a, b) for a, b in zip(left, right) if a != b)
    return f"values {first[0]} / {first[1]}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    failures = 0
    for name, build in entry.queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        start = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            problem = (
                compare(spark, connection, build, sql, sf_dir) if sql
                else f"rows only: {build(spark, sf_dir).count()}"
            )
        except Exception as error:  # report and go on to the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem and sql)
        print(f"{'ok  ' if not problem else 'DIFF'} {name} {time.time() - start:.1f}s {problem or ''}",
              flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main())
