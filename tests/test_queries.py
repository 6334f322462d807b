"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare
from offerlens.plans.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    rows, problem = compare(spark, name, QUERIES[name], SQL.get(name), FOLDER)
    assert problem is None, problem
    assert rows >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(SQL) <= set(QUERIES)
