"""Compares a query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return "-"
    if isinstance(value, float):
        return "-" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "__len__") and not isinstance(value, (str, bytes)):
        return str([plain(v) for v in value])
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in zip(*(frame[c].tolist() for c in names), strict=True))
