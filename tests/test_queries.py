import pytest
from conftest import TESTDATA

import __spark_entry__ as driver
import check
from panelforge.plans.catalog import QUERIES

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    assert check.compare(spark, connection, SF_DIR, name) == ""
