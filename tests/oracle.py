"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in values), key=repr)


def difference(frame, con, sql: str) -> str:
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} for {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows for {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else ""
