"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as contract
from learnlens.plans import catalogue, oracle

QUERIES = {name: contract.queries()[name] for name in catalogue.registered()}
SQL = oracle.statements()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert difference(QUERIES[name](spark, SMALL), SQL[name], duck) is None


def test_only_models_lack_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {
        "dropout_predictions",
        "next_problem_recommendations",
        "srv_recommendation_board",
    }


def test_entry_gives_rows(spark):
    assert contract.entry(spark).count() > 0
