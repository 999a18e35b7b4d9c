"""Every registered query against DuckDB on the same files."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from colsql import queries as own
from colsql import table_queries as tables

from .conftest import SF

QUERIES, ORACLES = own.queries() | tables.queries(), own.oracle_sql() | tables.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return None
        if hasattr(v, "year"):
            return str(pd.Timestamp(v))
        return round(float(v), 6) if isinstance(v, int | float | np.number) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(([cell(v) for v in r] for r in df.astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
