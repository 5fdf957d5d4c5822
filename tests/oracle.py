"""Compares a query's rows with its SQL on the driver's small tables."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def _value(v):
    return bytes(v) if isinstance(v, bytearray) else round(v, 9) if isinstance(v, float) else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_value(r[c]) for c in names) for r in df.collect()), key=str)


def expected(con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(names)
    return order, sorted((tuple(_value(r[names.index(c)]) for c in order) for r in got.fetchall()), key=str)
