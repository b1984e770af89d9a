"""Runs a query and its DuckDB equivalent over the same tables and compares rows, columns by name."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET threads = 2; SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float) and x.is_integer() or hasattr(x, "as_tuple"):
        x = float(x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int | float):
        return None if math.isnan(x) else round(float(x), 9)
    return str(x.replace(tzinfo=None)) if hasattr(x, "replace") and hasattr(x, "tzinfo") else x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> list[str]:
    """What differs, in words; nothing if all is equal."""
    got = con.sql(sql)
    if sorted(df.columns) != sorted(got.columns):
        return [f"columns {sorted(df.columns)} and {sorted(got.columns)}"]
    a, b = rows_of(df.columns, df.collect()), rows_of(got.columns, got.fetchall())
    if a == b:
        return []
    only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return [f"{len(a)} and {len(b)} rows; only here {only_a[:2]}; only there {only_b[:2]}"]
