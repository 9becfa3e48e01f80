import pytest


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
