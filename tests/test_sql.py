"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.oracle import ORACLE
from checks.queries import QUERIES
from tools import check_sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_sql.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert check_sql.differences(spark, con, FOLDER, name) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
