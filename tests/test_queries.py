"""Every query of the engine proper against its SQL on the smallest tables; those without SQL give rows."""

import os

import pytest

from geoloom.plans import registry

from oracle import compare, connection

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, QUERIES[name], SQL[name], FOLDER) is None
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
