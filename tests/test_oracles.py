"""Every query with an oracle equals DuckDB's answer on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from conftest import DATA
from quarry import queries as core


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(plain(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, duck, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), duck.sql(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_rows_only(spark, name):
    assert core.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).head(1)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
