"""Queries of the operators that SQL can express, against their SQL on the smallest tables."""

import pytest
from conftest import DATA, rows_of, rows_of_sql

from lectern.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(duck, SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
