"""Comparison of Spark's rows with DuckDB's."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connection(directory=DATA):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(directory):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{directory}/{f}'")
    return c


def check(spark, query, sql, c, directory=DATA):
    df = query(spark, directory)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    found = c.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(n)]) for n in columns) for r in found.fetchall()), key=repr)
    assert mine == theirs
