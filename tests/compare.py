"""Query results against the same query in DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd


def rows(df):
    def cell(v):
        if isinstance(v, list | tuple) or type(v).__name__ == "ndarray":
            return str(list(v))
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.6g}"
        return str(v)

    return Counter(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same(spark, folder, query, sql):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    got, want = query(spark, folder).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, f"{len(a)} and {len(b)} rows; only here {list((a - b))[:3]}, only there {list((b - a))[:3]}"
