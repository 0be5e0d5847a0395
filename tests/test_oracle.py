"""Every registered query against its SQL."""

import pytest

from rosterly import registry
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    same(spark, con, registry.QUERIES[name], registry.SQL[name], SF)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
