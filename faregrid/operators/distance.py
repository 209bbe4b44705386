"""Trip distances per pickup cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_trips(trips: DataFrame, vendor: str, min_distance: float) -> DataFrame:
    """Trips of one vendor above a distance, both ends on the grid.

    NaN compares greater than any number here but must not pass.
    """
    return trips.where(
        (F.col("dropoff_cell") > 0) & (F.col("pickup_cell") > 0)
        & (F.col("vendor_id") == vendor)
        & (F.col("trip_distance") > min_distance) & ~F.isnan("trip_distance"))


def mean_distance(trips: DataFrame, window_key: Column) -> DataFrame:
    """Count and mean distance per window and pickup cell (partial + final aggregate)."""
    return trips.groupBy(window_key, F.col("pickup_cell").alias("cell_id")).agg(
        F.count("*").alias("count"), F.avg("trip_distance").alias("avg_trip_distance"))
