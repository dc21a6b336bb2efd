import importlib

import pytest

import oracle

entry = importlib.import_module("__spark_entry__")
ORACLES = entry.oracle_sql()
QUERIES = importlib.import_module("narrowmat.catalog.queries").QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "j", "value"] and df.count() == 16


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    difference, _ = oracle.compare(spark, con, sf, entry.queries()[name], ORACLES[name])
    assert difference is None, difference
