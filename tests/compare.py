"""Runs a registered query in Spark and its SQL in DuckDB over the same tables."""

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def assert_same(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    columns = sorted(df.columns)
    result = connect(folder).sql(sql)
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    want = sorted((repr([plain(r[p]) for p in places]) for r in result.fetchall()))
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want
