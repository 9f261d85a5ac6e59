"""Every registered query with SQL gives the same rows as the SQL."""

import pytest
from compare import connection, spark_rows, sql_rows

from sparkveil import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_rows(spark, con, name):
    assert spark_rows(plans.QUERIES[name](spark, SF)) == sql_rows(con, plans.ORACLES[name])
