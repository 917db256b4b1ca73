"""Spark rows against DuckDB rows, as sorted text."""

from __future__ import annotations

import decimal
import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def text(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA:
        return "None"
    if isinstance(x, (list, tuple, np.ndarray)):
        return str([text(y) for y in x])
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (float, np.floating)):
        if math.isnan(x):
            return "None"
        x = round(float(x), 5)
        return str(int(x)) if x == int(x) else str(x)
    if isinstance(x, (int, np.integer)) and not isinstance(x, (bool, np.bool_)):
        return str(int(x))
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(zip(*[[text(v) for v in df[c].tolist()] for c in sorted(df.columns)], strict=True))
