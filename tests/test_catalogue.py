"""Every query with SQL gives the rows that DuckDB gives; the others give some."""

import pytest

from colloquy import plans

from .oracle import database, differences

SF = "/root/testdata/sf0.001"
NAMES = sorted(plans.queries())


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df, sql = plans.queries()[name](spark, SF), plans.oracle_sql().get(name)
    if sql:
        assert differences(df, con, sql) is None
    else:
        assert df.count() > 0
