"""Compares queries with their SQL in DuckDB on the driver's smallest tables."""

import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return None if not isinstance(v, list) and pd.isna(v) else v


def rows(frame, columns):
    return sorted((tuple(_plain(v) for v in r) for r in frame[columns].astype(object).values.tolist()), key=repr)


def same(spark, query, sql):
    got, want = query(spark, SF).toPandas(), duck().sql(sql).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got, columns) == rows(want, columns)
    return len(got)
