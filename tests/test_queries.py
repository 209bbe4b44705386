"""Every registered query against its SQL, and the plans the batch queries rest on."""

import contextlib
import io
import json

import pytest

from checks.compare import difference
from checks.oracles import ORACLES
from checks.queries import QUERIES, SLIDING
from faregrid.operators.last_dropoff import last_dropoff_by_taxi
from faregrid.operators.profit import median_profit
from faregrid.plans.distance import trip_distance
from faregrid.sources.driver_tables import trips


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name]) is None


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    json.dumps(ORACLES)


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_plans(spark, sf_dir, tmp_path):
    trips(spark, sf_dir).write.parquet(str(tmp_path / "trips"))
    table = spark.read.parquet(str(tmp_path / "trips"))
    distance = plan(trip_distance(table))
    assert distance.count("Exchange (") == 1
    assert "EqualTo(vendor_id,VTS), GreaterThan(trip_distance,1.0)" in distance
    assert "medallion" not in distance and "fare" not in distance
    median = plan(median_profit(table, SLIDING))
    assert median.count("Exchange (") <= 9 and "Expand" not in median
    assert "ReadSchema: struct<ts:timestamp,fare:double,tip:double,pickup_we:int,pickup_ns:int>" in median
    last = plan(last_dropoff_by_taxi(table, SLIDING))
    assert last.count("Exchange (") == 2 and "SortAggregate" not in last
    for text in (distance, median, last):
        assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text
