"""Comparing a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def database(sf_dir):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "None" if math.isnan(value) else f"{float(value):.5f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def same(df, sf_dir, sql):
    found = database(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(found.columns, found.fetchall())
