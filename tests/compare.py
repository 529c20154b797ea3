"""Run a query on Spark and its SQL on DuckDB over the same Parquet files, and compare all rows."""

from __future__ import annotations

import math

import duckdb

from pairloom.plans.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*columns))


def differences(df, con, sql: str) -> str | None:
    """None when names, types and all rows agree; else what differs."""
    got, want = df.toArrow(), con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} against {sorted(want.column_names)}"
    types = {
        n: (str(got.schema.field(n).type), str(want.schema.field(n).type))
        for n in got.column_names if str(got.schema.field(n).type) != str(want.schema.field(n).type)
    }
    if got.num_rows != want.num_rows:
        return f"{got.num_rows} rows against {want.num_rows}; types {types}"
    a, b = _rows(got), _rows(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} of {len(a)} rows differ, first {diff[0]}; columns {sorted(got.column_names)}; types {types}"
    return f"types {types}" if types else None
