"""Run queries and their SQL counterparts side by side."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


# Spark type name of each DuckDB type that the SQL counterparts return.
TYPES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def differences(df, connection, sql: str) -> str | None:
    """None when both sides agree, otherwise what differs."""
    relation = connection.execute(sql)
    expected_columns = [d[0] for d in relation.description]
    expected_types = {d[0]: str(d[1]) for d in relation.description}
    expected = rows_of(expected_columns, relation.fetchall())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    wrong_types = {
        c: (actual, expected_types[c]) for c, actual in df.dtypes if TYPES.get(expected_types[c]) != actual
    }
    if wrong_types:
        return f"types {wrong_types}"
    actual = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    return f"{len(wrong)} of {len(actual)} rows differ, first {wrong[0]}" if wrong else None
