"""Every core query against its SQL at the smallest scale; queries without SQL run, and have tests of their own."""

import pytest

import docmill.queries as q
from compare import connect, difference


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, data, con, name):
    assert not difference(q.queries()[name](spark, data), con, q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_runs(spark, data, name):
    assert q.queries()[name](spark, data).count() >= 0
