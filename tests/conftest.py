import pytest

from modloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values through a Column function, in order."""
    from pyspark.sql import functions as F

    def run(function, values, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        result = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
        return [row.r for row in result]

    return run
