"""Compares a query with its SQL over the same tables, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def _key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_key(x) for x in v) + "]"
    return str(v)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs, as text; empty if nothing does."""
    names, rows = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    left = sorted(tuple(_key(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    right = sorted(tuple(_key(r[i]) for i in at) for r in rows)
    if len(left) != len(right):
        return [f"{len(left)} and {len(right)} rows"]
    return [f"{order}: {a} and {b}" for a, b in zip(left, right, strict=True) if a != b][:3]
