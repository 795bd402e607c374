"""Side-by-side runs of a query and its SQL, as the driver compares them."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = connection.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def difference(df, sf_dir: str, sql: str) -> str:
    """Empty if both agree."""
    columns, want = oracle(sf_dir, sql)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    want = sorted_rows(columns, want)
    if got == want:
        return ""
    other = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return f"{len(got)} and {len(want)} rows; first differences {other}"
