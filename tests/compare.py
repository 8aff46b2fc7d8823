"""Compare a query's rows with those of its SQL in DuckDB."""

import math
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int | float | Decimal):
        return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.12g}")
    if isinstance(v, datetime):
        return str(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else str(v)


def assert_same(df, rel):
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in rel.project(", ".join(f'"{c}"' for c in names)).fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
