"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value.tolist() if hasattr(value, "tolist") else value


def rows(names: list[str], found: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def differences(df, con, text: str) -> str:
    """Empty if both have the same columns and rows."""
    result = con.execute(text)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows(names, result.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows, not {len(want)}"
    return next((f"{a} and {b}" for a, b in zip(got, want) if a != b), "")
