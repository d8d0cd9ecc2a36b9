"""Order-insensitive comparison of a Spark result with its SQL oracle."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return sorted((tuple(_value(v) for v in row) for row in rows), key=repr)


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if isinstance(v, float):
        return v + 0.0
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def rows_of(arrow_table) -> list[tuple]:
    return _canonical(arrow_table.to_pandas(integer_object_nulls=True))


def schema_of(arrow_table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in arrow_table.schema}
