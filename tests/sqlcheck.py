"""Runs a query and its SQL on the same tables and compares rows whatever their order."""

import glob
import math
import os

import duckdb


def connect(data):
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as from '{path}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def assert_same(con, frame, sql):
    relation = con.sql(sql)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    want = rows_of(relation.columns, relation.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
