"""Runs a query and its SQL, and compares rows without regard to order."""

import datetime
import math
import os

import duckdb


def connection(sf_dir):
    found = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        found.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return found


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    other = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    own = rows(df.columns, df.collect())
    assert own == rows(other.columns, other.fetchall())
    return own
