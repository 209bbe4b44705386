"""Mean trip distance per pickup cell in tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.functions.scalars import window_end_ms
from faregrid.operators.distance import long_trips, mean_distance
from faregrid.operators.panes import floor_div


def trip_distance(
    trips: DataFrame, window_ms: int = 2_000, vendor: str = "VTS", min_distance: float = 1.0,
    delay: str = "0 seconds",
) -> DataFrame:
    """Count and mean distance of one vendor's longer trips, batch or streaming."""
    kept = long_trips(trips, vendor, min_distance)
    if not trips.isStreaming:
        end = (floor_div(F.unix_millis("ts"), window_ms) + 1) * window_ms
        return mean_distance(kept, end.alias("window_end"))
    window = F.window("ts", f"{window_ms} milliseconds").alias("window")
    reports = mean_distance(kept.withWatermark("ts", delay), window)
    return reports.select(
        window_end_ms(F.col("window")).alias("window_end"),
        "cell_id", "count", "avg_trip_distance")


def replicated_distance(trips: DataFrame, copies: int, window_ms: int = 2_000) -> DataFrame:
    """`copies` independent distance queries over the same trips in one batch job."""
    from faregrid.sources.replay import replicate
    kept = replicate(long_trips(trips, "VTS", 1.0), copies)
    end = (floor_div(F.unix_millis("ts"), window_ms) + 1) * window_ms
    return kept.groupBy("query_id", end.alias("window_end"), F.col("pickup_cell").alias("cell_id")
                        ).agg(F.count("*").alias("count"),
                              F.avg("trip_distance").alias("avg_trip_distance"))
