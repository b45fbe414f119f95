import pytest

import __spark_entry__
from nestframe.queries import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, tiny, name):
    same(QUERIES[name](spark, tiny), tiny, SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_stream(spark, tiny):
    assert QUERIES["subscription_stream"](spark, tiny).count() > 0
