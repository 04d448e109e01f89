"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from causeway import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_its_sql(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in SQL:
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    other = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert len(rows) == len(other)
    assert sum(a != b for a, b in zip(rows, other, strict=True)) <= len(rows) * 0.002  # a last digit may round the other way
