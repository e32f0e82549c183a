"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def both(spark, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in cols)
    theirs = sorted((tuple(plain(x) for x in r) for r in connection(folder).execute(f"SELECT {names} FROM ({sql}) q").fetchall()), key=repr)
    return ours, theirs
