"""Spark results against DuckDB's on the same tables."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return ""
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6g}"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


def check(spark, con, query, sql, sf=SF):
    got, want = rows(query(spark, sf).toPandas()), rows(con.execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
