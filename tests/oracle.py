"""Comparing a query with its SQL on the small test tables."""

import decimal
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

TABLES = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):  # pandas has integers with nulls as floats
        return int(v) if float(v).is_integer() else round(float(v), 6)
    return str(v)


def rows(df):
    return sorted((repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False)))


def check(spark, query, sql):
    duckdb = pytest.importorskip("duckdb")
    if not TABLES.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    got, wanted = query(spark, str(TABLES)).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
