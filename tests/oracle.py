"""Run a query in Spark and its oracle in DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(_plain(v)) for v in value) + "]"
    return str(value)


def table(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(tuple(_plain(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], lines


def compare(df, connection, sql: str) -> str | None:
    """None if equal, else what differs."""
    spark_columns, spark_rows = table(df.columns, [tuple(r) for r in df.collect()])
    connection.execute(sql)
    names = [c[0] for c in connection.description]
    oracle_columns, oracle_rows = table(names, connection.fetchall())
    if spark_columns != oracle_columns:
        return f"columns {spark_columns} against {oracle_columns}"
    if len(spark_rows) != len(oracle_rows):
        return f"{len(spark_rows)} rows against {len(oracle_rows)}"
    wrong = [(a, b) for a, b in zip(spark_rows, oracle_rows, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(spark_rows)} rows differ, first {str(wrong[0])[:800]}"
    return None
