"""Runs registered queries beside their DuckDB SQL and compares rows as the driver does, by sorted columns."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return connection


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, sql, connection):
    """None if both agree, else a short account of the difference."""
    found = connection.sql(sql)
    want_columns, want = rows_of(found.columns, found.fetchall())
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if columns != want_columns:
        return f"columns {columns} against {want_columns}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} rows against {len(want)}: {odd}"
    return None
