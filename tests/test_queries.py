"""Every query against its SQL, on the smallest tables."""

import pytest

from burstpick.oracles import ORACLES
from burstpick.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, same, spark, tables):
    if name in ORACLES:
        same(QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, tables).count() > 0


def test_no_sql_without_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
