import pytest
from pyspark.sql import functions as F

from faregrid.operators.invariants import checked
from faregrid.operators.last_dropoff import empty_taxi_count
from faregrid.operators.profit import join_profitability


def test_a_broken_rule_fails_the_job_even_if_nothing_is_read(spark):
    rows = spark.range(10)
    assert checked(rows, F.col("id") < 10, "too large").count() == 10
    for bad in (F.col("id") < 9, F.when(F.col("id") < 9, True), F.lit(None).cast("boolean")):
        with pytest.raises(Exception, match="too large"):
            checked(rows, bad, "too large").count()


def test_windows_that_share_a_slot_fail_the_job(spark):
    reports = spark.createDataFrame([(10_000, "a", 5, 6), (10_003, "b", 5, 6), (20_000, "c", 5, 6)],
                                    "window_end long, medallion string, cell_we int, cell_ns int")
    assert empty_taxi_count(reports.where("medallion <> 'b'"), 10_000).count() == 2
    with pytest.raises(Exception, match="several windows"):
        empty_taxi_count(reports, 10_000).select("cell_we").count()


def test_equal_labels_pass(spark):
    profit = spark.createDataFrame([(10_000, 5, 6, 8.0)], "window_end long, cell_we int, cell_ns int, profit double")
    counts = spark.createDataFrame([(10_000, 5, 6, 2), (20_000, 5, 6, 1)], "window_end long, cell_we int, cell_ns int, count int")
    assert [tuple(r) for r in join_profitability(profit, counts, "window_end").collect()] == [(10_000, 5, 6, 4.0)]
