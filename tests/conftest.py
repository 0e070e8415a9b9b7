import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    changed = []

    def set_(key, value):
        changed.append((key, spark.conf.get(key, None)))
        spark.conf.set(key, str(value))

    yield set_
    for key, old in reversed(changed):
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


@pytest.fixture(scope="session")
def sf():
    return SF
