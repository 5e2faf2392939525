"""Rows of a Spark query against rows of its SQL."""

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 5) + 0.0)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(norm, x)) + "]"
    return str(x)


def rows(frame, columns):
    return sorted(tuple(norm(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


def same(query, sql, spark, con, folder: str = DATA):
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
