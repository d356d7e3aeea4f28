from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowpact.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("rowpact-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file:///tmp/checkpoints/rowpact-tests")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def values(spark):
    """values(["a", "b"]) -> DataFrame(row, v)."""
    def make(texts):
        return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "row bigint, v string")
    return make


@pytest.fixture
def mapped(values):
    """Apply a Column function to texts and return the results in order."""
    from pyspark.sql import functions as F

    def run(texts, function):
        rows = values(texts).select("row", function(F.col("v")).alias("r")).orderBy("row").collect()
        return [r["r"] for r in rows]
    return run
