"""Order-free comparison of a Spark result with a DuckDB one."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(_cell, v)) + "]"
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}"
    if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)):
        return f"{v:.6g}" if abs(int(v)) < 10**6 else str(v)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), Counter(tuple(map(_cell, r)) for r in df.itertuples(index=False))


def assert_same(ours, theirs):
    (a, x), (b, y) = rows(ours), rows(theirs)
    assert a == b
    assert x == y, (list((x - y).items())[:3], list((y - x).items())[:3])
