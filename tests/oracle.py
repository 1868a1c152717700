"""Rows of a query and of its SQL, made comparable."""

import math
from pathlib import Path

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from read_parquet('{path if path.is_file() else f'{path}/*.parquet'}')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}" if abs(value) < 1e15 else str(value)
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))
