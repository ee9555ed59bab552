"""Every named query against its SQL statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare
from manyview.plans import registry

entry.queries()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return compare.duck("sf0.001")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare.compare(spark, con, "sf0.001", name, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).columns == ["i", "j", "shared"]
