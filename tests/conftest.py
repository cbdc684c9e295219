import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("datascout-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="datascout-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


CATALOG_DDL = (
    "id string, name string, provider string, task string, rows bigint, columns bigint, size_bytes bigint, "
    "license string, popularity double, quality_score double, description string, tags array<string>"
)


@pytest.fixture(scope="session")
def catalog(spark):
    return spark.createDataFrame(
        [
            ("uci/1", "iris", "uci", "Classification", 150, 4, 5000, "cc-by", 80.0, 90.0, "Flowers", ["classification"]),
            ("hf/2", "mnist", "huggingface", "computer_vision", 70000, 784, 15000000, "mit", 95.0, 95.0, "MNIST dataset", ["vision"]),
            ("openml/3", "boston", "openml", "Regression", 506, 13, 50000, "gpl", 60.0, 75.0, "Boston housing", ["regression"]),
        ],
        CATALOG_DDL,
    )


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())
