"""Every query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import pytest
from compare import connect, difference
from conftest import SF

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, con, name):
    mine = QUERIES[name](spark, SF).toPandas()
    assert difference(mine, con.execute(ORACLE[name]).fetchdf()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
