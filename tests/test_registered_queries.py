"""Every registered query runs on the small tables; those with SQL must agree with DuckDB row by row."""

import pytest

import __spark_entry__ as entry
from corpusflow import plans
from corpusflow.plans import compare

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()
# queries that may be empty on the small tables
MAY_BE_EMPTY = set()


@pytest.fixture(scope="module")
def duck(small):
    return compare.duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    problem = compare.compare(spark, duck, small, name, QUERIES[name], ORACLES.get(name))
    if name in MAY_BE_EMPTY and problem == "no rows on either side":
        problem = ""
    assert problem == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
