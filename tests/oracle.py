"""Run a query and its SQL side by side."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    return [normal(x) for x in v] if isinstance(v, list) else v


def by_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=str)


def by_duckdb(sql, sf=SF):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    return cols, sorted((tuple(normal(row[k]) for k in at) for row in r.fetchall()), key=str)
