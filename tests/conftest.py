"""One local session for all tests."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def small(spark):
    """features, mask and annotations with a handful of rows each."""
    schema = "chrom string, start long, end long, name string, strand string"
    rows = {
        "features": [("chr1", 0, 100, "a", "+"), ("chr1", 60, 180, "b", "-"), ("chr2", 10, 40, "c", "+")],
        "mask": [("chr1", 0, 70, "m1", "+"), ("chr1", 90, 200, "m2", "+"), ("chr2", 0, 100, "m3", "-")],
        "annotations": [("chr1", 0, 30, "g1", "."), ("chr2", 0, 1000, "g2", "+")],
    }
    return {k: spark.createDataFrame(v, schema) for k, v in rows.items()}
