"""Queries against SQL, and their columns."""

import pytest

from tests.helpers import connect, same
from weftline.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])


def test_a_query_for_each_operator_is_registered():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
