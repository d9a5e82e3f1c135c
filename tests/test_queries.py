"""Every registered query against its DuckDB twin on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
pd = pytest.importorskip("pandas")

from cardloom.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    one = lambda v: "~" if pd.isna(v) else (f"{v:.9g}" if isinstance(v, float) else str(v))
    return list(frame.columns), sorted(tuple(map(one, r)) for r in frame.itertuples(index=False))


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLES[name]).df())
