"""Running a query beside its SQL and comparing rows without regard to order."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else float(f"{value:.12g}"))
    if isinstance(value, bool):
        return value
    return value if isinstance(value, (int, str, type(None))) else str(value)


def as_rows(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df: DataFrame, con, sql: str) -> list[str]:
    """What differs, in words; empty if nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    ours, theirs = as_rows(df.columns, df.collect()), as_rows(names, result.fetchall())
    if ours == theirs:
        return []
    mine, other = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return [f"{len(ours)} rows and {len(theirs)}; here only {mine}; in SQL only {other}"]
