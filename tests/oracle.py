"""Compare a registered query with its SQL on DuckDB, column by column and row by row."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value that both engines can agree on: floats to twelve digits."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def view(connection, sf_dir: str) -> None:
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            connection.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")


def differences(df, sql: str, sf_dir: str) -> tuple[int, int, list]:
    """(rows here, rows there, first differing pairs)."""
    connection = duckdb.connect()
    view(connection, sf_dir)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    there = rows_of(names, result.fetchall())
    here = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    return len(here), len(there), [(a, b) for a, b in zip(here, there, strict=False) if a != b][:3]
