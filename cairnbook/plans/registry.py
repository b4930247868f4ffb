"""Collects queries and their SQL; SQL of literal rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator id, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rows_sql(columns: str, *rows) -> str:
    """SQL of literal rows: None, numbers, booleans, texts, dates and lists of these."""

    def cell(v):
        if isinstance(v, list):
            return "[" + ", ".join(map(cell, v)) + "]" if v else "CAST([] AS VARCHAR[])"
        if isinstance(v, dt.date):
            return f"DATE '{v.isoformat()}'"
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"
