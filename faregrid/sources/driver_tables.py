"""Trips derived from the `events` table of the test data (no taxi data is at hand).

Coordinates, fares and vendors are plain arithmetic on the event columns. Time is
replayed from `event_id` at 20 events/s, as an ingestion clock would do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.functions import grid
from faregrid.sources.trips import cells_of

EVENT_GAP_MS = 50


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _spot(base: float, factor: int, steps: int):
    return F.lit(base) + ((F.col("event_id") * factor) % steps) * F.lit(0.0023)


def raw_trips(events: DataFrame) -> DataFrame:
    """Trips with coordinates, before any grid mapping."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.timestamp_millis(F.col("event_id") * EVENT_GAP_MS).alias("ts"),
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("medallion"),
        F.when(F.col("event_type").isin("click", "view"), "VTS").otherwise("CMT").alias("vendor_id"),
        (F.col("value") / F.lit(10.0)).alias("trip_distance"),
        F.col("value").alias("fare"),
        ((F.col("event_id") % 7) * F.lit(0.5)).alias("tip"),
        _spot(40.75, 7919, 6).alias("pickup_lat"),
        _spot(-73.99, 104729, 5).alias("pickup_lon"),
        _spot(40.75, 15485863, 6).alias("dropoff_lat"),
        _spot(-73.99, 32452843, 5).alias("dropoff_lon"))


def on_grid(trips: DataFrame) -> DataFrame:
    """Keeps trips with both ends on the grid and replaces coordinates by cells."""
    return cells_of(trips).withColumns({
        "pickup_cell": grid.flat_id(F.col("pickup_we"), F.col("pickup_ns")),
        "dropoff_cell": grid.flat_id(F.col("dropoff_we"), F.col("dropoff_ns"))})


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_grid(raw_trips(read_events(spark, sf_dir)))
