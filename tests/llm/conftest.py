import pytest
from pyspark.sql import functions as F
from samples import NASTY, documents


@pytest.fixture(scope="session")
def nasty(spark):
    return documents(spark, NASTY)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 9)] + [(None, 1, 1), (1, None, None), (3, 1, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("label", F.lit("clash"))


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
