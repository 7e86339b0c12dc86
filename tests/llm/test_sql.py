from __future__ import annotations

import pytest
from compare import assert_same

from tokenloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), registry.SQL[name], sf_dir)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
