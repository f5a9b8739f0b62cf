"""Every registered query against its comparison SQL, on the smallest tables."""

import math

import duckdb
import pytest

from brightloom import catalog
from brightloom.registry import REGISTRY
from brightloom.tables import TABLES

catalog.queries()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    return con


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, tiny, name):
    q = REGISTRY[name]
    df = q.build(spark, tiny)
    names = sorted(df.columns)
    mine = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute(q.oracle)
    cols = [d[0] for d in result.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    other = sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert mine == other


def test_names_are_covered():
    assert all(q.covers and q.oracle for q in REGISTRY.values())
