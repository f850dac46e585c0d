"""Compare registered queries with their DuckDB text."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return ("f", "nan") if math.isnan(value) else ("f", repr(round(value, 9) + 0.0))
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, int):
        return ("i", str(value))
    return ("n", "") if value is None else ("s", str(value))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> tuple[int, str | None]:
    """(rows, fault); no fault means equal columns and values."""
    ours = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(names, cursor.fetchall())
    if ours[0] != theirs[0]:
        return len(ours[1]), f"columns {ours[0]} <> {theirs[0]}"
    if ours[1] != theirs[1]:
        left, right = set(ours[1]), set(theirs[1])
        a, b = sorted(left - right)[:2], sorted(right - left)[:2]
        return len(ours[1]), f"rows {len(ours[1])} <> {len(theirs[1])}; spark only {len(left - right)} {a}; duckdb only {len(right - left)} {b}"
    return len(ours[1]), None
