from __future__ import annotations

import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from places import SF001  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[*]")
        .appName("txrisk-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # set a checkpoint folder only where the session has none (tests)
    if not (session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir()):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="txrisk-test-ckpt-"))
    yield session


@pytest.fixture(scope="session")
def tx(spark):
    from txrisk.sources.fixture import transactions

    return transactions(spark, SF001)


@pytest.fixture()
def tmp_out(spark):
    from txrisk.session import fresh_path

    return lambda name: fresh_path(spark, name)
