"""Compares registered queries with their SQL on the driver's tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if df and the SQL have equal rows; else what differs."""
    names, rows = rows_of_sql(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    if mine == theirs:
        return ""
    odd = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
    return f"{len(mine)} rows against {len(theirs)}; {order}: {odd}"
