"""Compares a query's rows with those of its SQL."""

import glob
import math
import os
from collections import Counter

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, (bytes, str)):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows(frame: pd.DataFrame) -> Counter:
    columns = sorted(frame.columns)
    return Counter(tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def expected(sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con.sql(sql).df()


def check(spark, query, sql: str) -> None:
    got, want = query(spark, SF).toPandas(), expected(sql)
    assert sorted(got.columns) == sorted(want.columns)
    g, w = rows(got), rows(want)
    assert g == w, (list((g - w).items())[:3], list((w - g).items())[:3])
