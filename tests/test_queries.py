import pytest

import __spark_entry__
from matrixloom import queries

from .oracle import SF, same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name]) > 0


def test_entry(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("max(l_orderkey) + 1").first()[0]
    assert __spark_entry__.entry(spark).count() == orders * 12  # a row of 12 columns for every order
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
