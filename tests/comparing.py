"""Rows of a query against rows of its SQL, as sorted text of values by column name."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}" if x != int(x) or abs(x) > 1e15 else str(int(x)) if not math.isinf(x) else str(x)
    if isinstance(x, Decimal):
        return plain(float(x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return str(x)


def lines(columns: list[str], rows: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def spark_lines(df) -> tuple[list[str], list[str]]:
    return lines(df.columns, [tuple(r) for r in df.collect()])


def duck_lines(sf_dir: str, sql: str) -> tuple[list[str], list[str]]:
    out = duck(sf_dir).execute(sql)
    return lines([c[0] for c in out.description], out.fetchall())
