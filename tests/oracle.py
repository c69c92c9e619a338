"""Rows of a query and of its SQL in a form that can be compared."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _value(x) -> str:
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in values)


def of_spark(df) -> list[tuple]:
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con, sql: str) -> list[tuple]:
    relation = con.sql(sql)
    return rows(relation.columns, relation.fetchall())
