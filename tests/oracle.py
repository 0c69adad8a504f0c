"""Comparison of a query with its DuckDB equivalent."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(folder=SMALL):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, con, query, sql, folder=SMALL):
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert columns == sorted(rel.columns)
    theirs = sorted((tuple(plain(x) for x in r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert mine == theirs
