"""Every screen query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from screenspark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def _rows(df: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return "null"
        return v if isinstance(v, str) else f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    mine, other = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(other.columns)
    assert _rows(mine) == _rows(other)
