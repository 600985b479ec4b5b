"""Comparison of registered queries with their SQL on the smallest tables."""

import glob
import os

FOLDER = "/root/testdata/sf0.001"


def connection(folder=FOLDER):
    import duckdb

    con = duckdb.connect()
    for p in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def cell(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def assert_same(df, cursor):
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
    got = sorted(tuple(cell(x) for x in r) for r in df.select(sorted(df.columns)).collect())
    assert got == want
