"""Every registered query of the reference's operators against its SQL, or against its invariants."""

import pytest

import __spark_entry__
from newsloom.plans import registry

from .oracle import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, con, name):
    compare(__spark_entry__.queries()[name](spark, SF), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF).collect()
    assert rows or name in ("j3_similar_posts",)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
