"""Compares a query with its DuckDB counterpart on one data set."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in row)) for row in rows)


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    found, wanted = query(spark, sf), con.sql(sql)
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    order = [wanted.columns.index(n) for n in names]
    assert rounded(tuple(r[n] for n in names) for r in found.collect()) == rounded(tuple(r[i] for i in order) for r in wanted.fetchall())
