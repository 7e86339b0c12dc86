"""Comparison of a query with its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    plain = lambda x: None if x is None or x is pd.NA or x != x else float(f"{x:.9g}") if isinstance(x, float) else x
    return sorted((tuple(plain(x) if not isinstance(x, int) else float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in df.itertuples(index=False)), key=repr)


def assert_same(spark_df, sql: str, sf_dir: str) -> None:
    want = duck(sf_dir).sql(sql).df()
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
