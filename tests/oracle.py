"""A query and its SQL side by side on the smallest tables."""

import math
import os

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def connection(directory=DATA):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(directory):
        path = f"{directory}/{name}" + ("/*.parquet" if os.path.isdir(f"{directory}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, query, sql, directory=DATA):
    df = query(spark, directory)
    own = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = connection(directory).execute(sql)
    other = rows_of([d[0] for d in done.description], done.fetchall())
    assert own[0] == other[0]
    assert own[1] == other[1]
