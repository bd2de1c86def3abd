"""Compares a query with its SQL twin in DuckDB, all rows."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v) -> str:
    if isinstance(v, np.ndarray | list):
        return str([_cell(x) for x in v])
    if pd.isna(v):
        return "null"
    if isinstance(v, float | np.floating):
        return f"{v:.9g}"
    return str(v).removesuffix(" 00:00:00")


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
