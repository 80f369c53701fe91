"""Running a query and its SQL side by side."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def connect(folder=SF):
    c = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            p = f"{folder}/{f}"
            c.execute(f"create view {f[:-8]} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def same(spark, con, query, sql, folder=SF):
    df = query(spark, folder)
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(df.columns)
    mine = sorted((tuple(normal(row[c]) for c in cols) for row in df.collect()), key=repr)
    theirs = sorted((tuple(normal(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert mine == theirs
