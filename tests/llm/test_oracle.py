"""The queries that SQL can express, against it: the same columns, types and rows."""

import pytest

from rosterly.llm import queries
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    same(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF)
