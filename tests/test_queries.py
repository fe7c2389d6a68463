"""Every named query against its SQL on the smallest supplied tables."""

import pytest
from compare import compare, duck, sf_dir

import __spark_entry__ as entry_points

ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()
# fits that take long on any data; the same code runs with small settings in test_learning
LONG = {"classification_models", "regression_models"}


@pytest.fixture(scope="module")
def con():
    return duck(sf_dir())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, sf_dir()), con, ORACLES[name]) in (None, "no rows")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, sf_dir()).count() > 0


def test_entry_is_the_ranked_queue(spark):
    ranks = [r.priority_rank for r in entry_points.entry(spark).collect()]
    assert ranks and ranks == sorted(ranks)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
