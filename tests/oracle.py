"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import os

import duckdb

DATA = os.environ.get("WAYFOLD_TEST_DATA", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def _plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def compare(spark, con, query, text):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    relation = con.sql(text)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted(str(tuple(_plain(r[i]) for i in at)) for r in relation.fetchall())
    got = sorted(str(tuple(map(_plain, r))) for r in df.select(*columns).collect())
    assert got == want
