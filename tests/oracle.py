"""Runs a query in Spark and its SQL in DuckDB on the same tables, and compares rows."""

from __future__ import annotations

import os
from collections.abc import Callable

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connected() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    shown = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else v
    return sorted(str([shown(v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else v) for v in r]) for r in df.itertuples(index=False))


def compare(spark, con: duckdb.DuckDBPyConnection, run: Callable, sql: str, least: int = 1) -> None:
    got, want = run(spark, DIR).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) >= least
