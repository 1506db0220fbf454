"""Rows of a query and of its DuckDB oracle, in one order, numbers rounded."""

import glob
import os

import duckdb


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=str)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    return names, sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
