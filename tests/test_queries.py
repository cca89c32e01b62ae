"""Every registered query against its SQL, over whole tables."""

import pytest

from millrace.plans import more_queries, queries  # noqa: F401
from millrace.plans.registry import ORACLE_SQL, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, same, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck("sf0.001", ORACLE_SQL[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
