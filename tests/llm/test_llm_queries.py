"""The registered queries with SQL against DuckDB, on the smallest tables."""

import os

import pytest
from test_queries import SF, compare

from confab.llm import queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.SQL[name])


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
