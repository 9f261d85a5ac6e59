"""The corpus queries that SQL can express give the same rows as their SQL."""

import pytest
from compare import connection, spark_rows, sql_rows

from sparkveil.llm import entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_rows(spark, name):
    assert spark_rows(entry.QUERIES[name](spark, SF)) == sql_rows(connection(SF), entry.ORACLES[name])
