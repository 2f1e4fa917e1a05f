"""Holds a Spark result against DuckDB: same columns, same rows in any order, floats at 6 places."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {path.name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and np.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return None
    if isinstance(v, (float, np.floating)):
        v = round(float(v), 6)
        return int(v) if v == int(v) else v
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return int(v) if isinstance(v, (int, np.integer)) else str(v)


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(_cell(v) for v in r) for r in frame[names].itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(spark_frame, con, sql: str) -> None:
    left, right = spark_frame.toPandas(), con.execute(sql).fetch_df()
    assert sorted(left.columns) == sorted(right.columns)
    a, b = rows(left), rows(right)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) or isinstance(q, float)) and abs(p - q) <= 2e-6 for p, q in zip(x, y, strict=True)), (x, y)
