"""Comparing a query with its SQL on the same tables."""

import glob
import math
import os

import numpy as np
import pandas as pd


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, (float, np.floating)) and math.isnan(x)):
        return "~"
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19]
    if isinstance(x, (float, np.floating)):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(bool(x)) if isinstance(x, (bool, np.bool_)) else str(x)


def rows(frame):
    return sorted("|".join(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def check(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), connect(sf).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
