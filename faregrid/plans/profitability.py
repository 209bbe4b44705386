"""Profitable areas: median profit per cell divided by the taxis left empty there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faregrid.operators.last_dropoff import empty_taxi_count, last_dropoff_by_taxi
from faregrid.operators.median import BANDS_PER_OCTAVE
from faregrid.operators.panes import Sliding
from faregrid.operators.profit import CELL, join_profitability, median_profit, total_profit
from faregrid.streaming.profitability import stream_profitable_areas, stream_total_profit

TRIP_COLUMNS = ["seq", "ts", "medallion", "pickup_we", "pickup_ns", "dropoff_we", "dropoff_ns",
                "fare", "tip"]


def profitable_areas(
    trips: DataFrame, window_ms: int = 150_000, slide_ms: int = 10_000,
    bands_per_octave: int = BANDS_PER_OCTAVE, delay: str = "0 seconds", state_bands: int | None = None,
) -> DataFrame:
    """Profitability per cell and sliding window, for a batch or a streaming DataFrame.

    Profit of the window that ends at E is divided by the number of taxis whose last trip
    in the window that ended one slide earlier dropped off in the cell. On a stream, trips may
    arrive up to `delay` behind the latest one, and `state_bands` (bands per doubling of the gain) keeps a
    cell that sees very many different gains in a window from being one state row.
    """
    sliding = Sliding(window_ms, slide_ms)
    trips = trips.select(*TRIP_COLUMNS)
    if trips.isStreaming:
        return stream_profitable_areas(trips, sliding, delay, state_bands)
    profit = median_profit(trips, sliding, bands_per_octave)
    counts = empty_taxi_count(last_dropoff_by_taxi(trips, sliding), slide_ms)
    return join_profitability(profit, counts, "window_end")


def total_profit_by_cell(
    trips: DataFrame, window_ms: int = 150_000, slide_ms: int = 10_000, delay: str = "0 seconds",
) -> DataFrame:
    """Summed fares and tips per cell and sliding window, for a batch or a streaming DataFrame."""
    sliding = Sliding(window_ms, slide_ms)
    if trips.isStreaming:
        return stream_total_profit(trips.withWatermark("ts", delay), sliding)
    return total_profit(trips, sliding)


def top_profitable_cells(areas: DataFrame, k: int = 10) -> DataFrame:
    """The `k` most profitable cells of every window; ties go to the smaller cell.

    A window has at most 360,000 cells, and Spark keeps only k rows per window and task
    before the shuffle. On a stream, call it per window batch inside `foreachBatch`.
    """
    order = Window.partitionBy("window_end").orderBy(F.desc("profitability"), *CELL)
    return areas.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
