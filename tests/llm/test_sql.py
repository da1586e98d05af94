"""Registered text queries that have SQL give its rows."""

import pytest

from tests.test_oracle import same
from zonalis.llm import queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_url_cascade"])
def test_same_rows(name, spark, sf_dir, duck):
    same(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def test_new_queries_are_registered():
    assert {"op11_prefix_trie", "op12_url_cascade", "op13_periodic_runs"} <= set(queries.queries())
