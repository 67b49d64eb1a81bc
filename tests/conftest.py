import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from gleaner.session import ship_package

    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column for a list of texts (column ``t``)."""

    def run(column, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("x")).collect()
        return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
