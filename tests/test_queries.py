"""Every registered query runs; those with SQL must give the same rows as DuckDB."""

import os

import pytest

import compare
from tarnkit.plans import all_checks, all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, database, name):
    result = all_queries()[name](spark, FOLDER).toPandas()
    assert len(result) > 0
    check = all_checks().get(name)
    if check:
        problem = compare.differences(result, database.sql(check).df())
        assert problem is None, problem


def test_checks_belong_to_queries():
    assert set(all_checks()) <= set(all_queries())
