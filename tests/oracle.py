"""Runs a query and its DuckDB form over one data folder and compares the rows."""

from __future__ import annotations

import math

import duckdb

from loomstead.sources.tables import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


def rows(found: list, columns: list[str]) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differs(df, con, sql: str) -> str:
    """Nothing, or what is different."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    return next((f"{a} and {b}" for a, b in zip(got, want) if a != b), "")
