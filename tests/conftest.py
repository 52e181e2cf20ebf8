import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("TZ", "UTC")
    session = (
        SparkSession.builder.master("local[4]")
        .config(
            map={
                "spark.sql.shuffle.partitions": "4",
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.driver.memory": "4g",
                "spark.sql.session.timeZone": "UTC",
                "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            }
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows_of():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
