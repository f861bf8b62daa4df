"""Runs a query and its DuckDB statement on the same files and compares the rows."""

import math
import os

import duckdb
import pandas as pd


def connect(folder, recursive=False):
    """Views of a folder's Parquet files; with `recursive`, of Parquet folders in it."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}{"/*.parquet" if recursive else ""}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((x is None, str(x)) for x in t))


def check(spark, con, folder, query, sql):
    got = query(spark, folder)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
