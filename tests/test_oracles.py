"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from modloom.plans import oracles, registry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

QUERIES = registry.queries()
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    # a trained model is beyond SQL: test_joint holds it to plain forms and separate fits
    assert set(QUERIES) == set(ORACLES) | {"train_joint"}
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, connection, name):
    assert compare(QUERIES[name](spark, FOLDER), connection, ORACLES[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 2
