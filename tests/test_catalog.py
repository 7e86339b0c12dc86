from __future__ import annotations

import pytest
from compare import assert_same

from tokenloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
