"""Registered queries against DuckDB on the smallest tables."""

import datetime
import functools

import pytest
from conftest import SF

from bruit.plans import queries
from bruit.plans.registry import ORACLES, QUERIES

# Graphs and clusters of the same settings are made once for all queries that begin with them.
queries._graph = functools.cache(queries._graph)
queries._clusters = functools.cache(queries._clusters)


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, columns, data):
    at = [columns.index(n) for n in names]
    return sorted((tuple(norm(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert rows(names, df.columns, df.collect()) == rows(names, want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
