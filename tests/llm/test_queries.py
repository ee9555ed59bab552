"""Queries of manyview.llm against their SQL on the smallest tables."""

import compare
import pytest

from manyview.llm import queries

#: Without SQL; the other modules here hold these against brute force.
BY_BRUTE_FORCE = {"op2_substring_dedup", "op6_personal_data", "op7_lm_score", "op10_quality_rules", "op11_nearest_neighbours", "op12_tokenizer_alignment"}


@pytest.fixture(scope="module")
def con():
    return compare.duck("sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    ok, message = compare.compare(spark, con, "sf0.001", name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def test_every_query_is_tested():
    assert set(queries.QUERIES) == set(queries.ORACLES) | BY_BRUTE_FORCE
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
