"""All registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.queries import all_oracles

DIR = "/root/testdata/sf0.001"
#: Every query with SQL; those of the text operators have a test of their own beside them.
NAMES = sorted(set(all_oracles()))

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def rows(df):
    none = lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else x
    key = lambda x: x if isinstance(x, str) or x is None else float(x) if not isinstance(x, bool) else str(x)
    return sorted((tuple(str(key(none(x))) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)))


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
