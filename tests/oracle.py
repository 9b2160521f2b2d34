"""Compare a query with its SQL, as sets of rows with columns by name."""

import glob
import os

import duckdb


def view_connection(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if hasattr(v, "quantize"):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr), cols


def sql_rows(c, sql):
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    return sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr), cols
