"""The registered queries against their SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lakeloom.llm import queries

from .conftest import DATA

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "~" if pd.isna(v) else (repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v))
    return sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_names():
    numbers = [int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")]
    assert numbers == list(range(1, 11))
