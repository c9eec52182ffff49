"""Every registered query against its SQL, run by an independent engine."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, difference
from tidegauge.plans.registered import ORACLE, QUERIES


@pytest.fixture(scope="module")
def engine(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, engine, sf_dir):
    assert difference(spark, engine, name, sf_dir) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_entry(spark):
    flagship = entry(spark)
    assert flagship.count() == 87 * 5
    assert flagship.columns[:3] == ["month", "tech_key", "tech_name"]
