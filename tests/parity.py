"""Run a registered query beside its DuckDB oracle and compare whole results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    return v


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        q = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{q}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def compare(spark, name: str, query, sql: str, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    names, rows = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    ours = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(_norm(r[i]) for i in at) for r in rows), key=repr)
    assert len(ours) == len(theirs), (name, len(ours), len(theirs))
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (name, cols, a, b)
    return len(ours)
