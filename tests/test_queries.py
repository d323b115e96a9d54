"""Every query with an SQL twin gives the twin's rows at the smallest scale."""

import pytest

import compare
from notemill.plans.oracles import ORACLES
from notemill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


def test_twins_are_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    diff = compare.difference(got, duck.execute(ORACLES[name]).fetchdf())
    assert not diff, diff


ALONE = {"linear_probe": 1, "text_classifier": 1, "token_classifier": 1, "search_trials": 20}


@pytest.mark.parametrize("name", sorted(ALONE))
def test_query_without_twin(spark, sf, name):
    assert QUERIES[name](spark, sf).count() == ALONE[name]


def test_every_query_is_checked():
    assert set(ALONE) | set(ORACLES) == set(QUERIES)
