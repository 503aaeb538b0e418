"""Rows of a query and of its DuckDB statement, in a form that can be compared."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 8)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


def both(spark, query, sql, sf=SF):
    df = query(spark, sf)
    found = connect(sf).execute(sql)
    names = [d[0] for d in found.description]
    return table(df.columns, [tuple(r) for r in df.collect()]), table(names, found.fetchall())
