"""Comparison of a query with its SQL in DuckDB: same columns, same rows with the same multiplicity."""

import datetime
import math
import os
from collections import Counter

import duckdb


def connect(root):
    c = duckdb.connect()
    for f in os.listdir(root):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{root}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return object() if math.isnan(v) else v  # a NaN equals nothing, as for the driver
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def expected(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
