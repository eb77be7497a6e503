"""Rows of a Spark frame and of DuckDB SQL over the same tables, in a form that can be compared."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(columns: list[str], data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def of_spark(df) -> list[str]:
    return rows(df.columns, df.collect())


def of_duckdb(sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        return columns, rows(columns, found.fetchall())
