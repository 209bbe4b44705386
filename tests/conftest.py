import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faregrid.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(TESTDATA):
        pytest.skip("test data is not at hand")
    return TESTDATA


@pytest.fixture(scope="session")
def make_trips(spark):
    """Trips from (seq, ts_ms, medallion, pickup cell, dropoff cell, fare, tip) tuples."""
    from pyspark.sql import functions as F

    def make(rows):
        return spark.createDataFrame(
            [(s, t, m, *p, *d, float(f), float(g)) for s, t, m, p, d, f, g in rows],
            "seq long, ts_ms long, medallion string, pickup_we int, pickup_ns int, "
            "dropoff_we int, dropoff_ns int, fare double, tip double",
        ).withColumn("ts", F.timestamp_millis("ts_ms")).drop("ts_ms")
    return make
