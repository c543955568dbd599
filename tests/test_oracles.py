import pytest

import __spark_entry__ as driver
from checks.compare import connect, differences
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, con, name):
    count, wrong = differences(spark, con, SF, name)
    assert not wrong, wrong
    assert count > 0 or name == "crawled_filter"


def test_entry(spark):
    assert driver.entry(spark).count() == 12
