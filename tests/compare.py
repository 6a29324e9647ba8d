"""Comparing a Spark result with DuckDB's over the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

SMALL = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")


def connect(root: str):
    con = duckdb.connect()
    for name in os.listdir(root):
        table, path = name.split(".")[0], f"{root}/{name}"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def same(frame, con, sql) -> bool:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert counted(frame.columns, frame.collect()) == counted(columns, result.fetchall())
    return True
