"""Every query of the catalogue on the smallest tables: against SQL where it has some."""

import pytest

from quirespark.plans import catalogue
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, connection, name):
    df, sql = catalogue.queries()[name](spark, FOLDER), catalogue.oracle_sql().get(name)
    if sql:
        same(df, connection, sql)
    else:
        assert df.columns and df.collect() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
