"""Runs a registered query and its SQL and compares the rows."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def plain(value):
    if isinstance(value, datetime):
        return value.isoformat(sep=" ", timespec="microseconds")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(repr([plain(row[i]) for i in order]) for row in rows)


def compare(spark, db, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    assert got[0] == want[0], f"columns {got[0]} != {want[0]}"
    assert len(got[1]) == len(want[1]), f"{len(got[1])} rows, expected {len(want[1])}"
    differing = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    assert not differing, f"{len(differing)} rows differ, first: {differing[0]}"
    return len(got[1])
