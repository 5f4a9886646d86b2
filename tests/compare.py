"""Spark results against DuckDB on the same files."""

import os

import duckdb
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def rows(d: pd.DataFrame) -> list[tuple]:
    d = d[sorted(d.columns)]

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA:
            return "None"
        if isinstance(x, float):
            return repr(round(x, 9))
        return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(cell(x) for x in r) for r in d.astype(object).where(d.notna(), None).itertuples(index=False))


def same(spark_rows: pd.DataFrame, oracle_rows: pd.DataFrame) -> None:
    assert sorted(spark_rows.columns) == sorted(oracle_rows.columns)
    assert rows(spark_rows) == rows(oracle_rows)
