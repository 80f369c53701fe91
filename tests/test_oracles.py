"""Every query of the library against its SQL, and the others for rows that come again."""

import pytest

from quarry.plans import all_queries, oracles

from . import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_its_sql(spark, con, name):
    oracle.same(spark, con, all_queries()[name], oracles()[name])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(oracles())))
def test_query_without_sql_gives_the_same_twice(spark, name):
    q = all_queries()[name]
    first, second = (sorted(map(repr, q(spark, oracle.SF).collect())) for _ in range(2))
    assert first == second


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "line_no", "line"]
    assert set(e.oracle_sql()) <= set(e.queries())
