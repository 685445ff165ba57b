import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from corpusflow.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "corpusflow-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def column(spark):
    """column(values, expression) -> list of results of a column function over literal texts."""
    from pyspark.sql import functions as F

    def run(values, expression):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, text string").coalesce(1)
        return [r["out"] for r in df.select("i", expression(F.col("text")).alias("out")).orderBy("i").collect()]

    return run
