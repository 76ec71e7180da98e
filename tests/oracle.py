"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if path.is_dir() else f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(value) if isinstance(value, list) else value


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    told = con.execute(sql)
    names = [c[0] for c in told.description]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    theirs = [tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall()]
    ours = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    assert ours, "no rows"
    assert sorted(map(str, ours)) == sorted(map(str, theirs))
