"""Comparison of a query with its SQL twin."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(data_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{data_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}" if abs(v) < 1e8 else str(int(v)) if float(v).is_integer() else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in values)


def same(df, con, sql):
    cur = con.execute(sql)
    return rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())
