"""Run registered queries beside their SQL and compare schema, count and values.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from checks import oracle, queries
from litrewise.placement import settled_within


def session(cpus: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{file}'")
    return connection


def _plain(value: object) -> object:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (pd.Timestamp, dt.datetime)):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, float):
        return repr(float(value))
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple("" if v is None else v for v in r))


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both results are equal, else a short description."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} / {len(expected)}"
    unequal = [(a, e) for a, e in zip(actual, expected) if a != e]
    return f"{len(unequal)} unequal rows, first {unequal[0]}" if unequal else None


def main(sf_dir: str, chosen: list[str]) -> int:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sql = oracle.statements()
    failed = 0
    for name, run in queries.registered().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        try:
            with settled_within(spark):
                df = run(spark, sf_dir)
                if name in sql:
                    problem = difference(df, connection, sql[name])
                    verdict = "equal" if problem is None else f"DIFFERENT {problem}"
                else:
                    problem, verdict = None, f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem = verdict = f"ERROR {type(error).__name__} {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:22} {time.time() - started:6.1f}s {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
