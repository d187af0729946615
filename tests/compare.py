"""Spark rows against DuckDB rows of the same tables."""

import datetime
import glob
import os

import duckdb
import numpy as np


def norm(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        src = f if os.path.isfile(f) else f"{f}/*.parquet"
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{src}')")
    return c


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((norm(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((norm(tuple(r[i] for i in at)) for r in cur.fetchall()), key=repr)
    assert got == want, (len(got), len(want), list(set(map(repr, got)) ^ set(map(repr, want)))[:4])
