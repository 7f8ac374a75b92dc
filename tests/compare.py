"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.sql(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(frame):
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple(None if x is None or x != x else str(round(x, 6)) if isinstance(x, float) else str(x) for x in row))
    return sorted(out, key=lambda r: tuple(x or "" for x in r))
