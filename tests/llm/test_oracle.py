"""Queries of the subpackage beside their DuckDB SQL."""

import pytest

from agoralake.llm.oracle import ORACLE_SQL
from agoralake.llm.queries import QUERIES
from tests.oracle import compare, connection

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connection(SF), ORACLE_SQL[name]) == ""


def test_queries_of_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in (*range(1, 12), 13)] == [1] * 12
