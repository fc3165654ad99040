"""Runs a check in Spark and DuckDB and compares the results exactly."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal

import duckdb

from checks.views import DRIVER_SCHEMAS


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in DRIVER_SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    values = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(values, key=repr)


def spark_rows(df):
    return _sorted(df.columns, df.collect())


def duckdb_rows(con, sql):
    cursor = con.execute(sql)
    return _sorted([c[0] for c in cursor.description], cursor.fetchall())


def difference(spark_result, duckdb_result) -> str | None:
    """A description of the first difference, or None."""
    (s_cols, s_rows), (d_cols, d_rows) = spark_result, duckdb_result
    if s_cols != d_cols:
        return f"columns {s_cols} != {d_cols}"
    if len(s_rows) != len(d_rows):
        return f"{len(s_rows)} rows != {len(d_rows)} rows"
    for s, d in zip(s_rows, d_rows):
        if s != d:
            return f"{s} != {d}"
    return None
