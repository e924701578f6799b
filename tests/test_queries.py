"""Every query against its SQL counterpart on the smallest tables; queries without one must run."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from skein import plans
from tests.conftest import DATA

duckdb = pytest.importorskip("duckdb")
FOLDER = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def _cell(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6f}"
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, str(FOLDER)).toPandas()
    if name in plans.ORACLES:
        want = duck.execute(plans.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
