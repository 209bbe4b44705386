"""Profit per pickup cell, and the join that turns it into profitability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faregrid.functions.scalars import gain, profitability, window_end_ms
from faregrid.operators.invariants import checked
from faregrid.operators.median import BANDS_PER_OCTAVE, sliding_median
from faregrid.operators.panes import Sliding, explode_windows, gather

CELL = ["cell_we", "cell_ns"]


def gains(trips: DataFrame) -> DataFrame:
    """`ts`, pickup cell and gain of the trips that have one, for batch and stream alike."""
    return trips.select(
        "ts", F.col("pickup_we").alias("cell_we"), F.col("pickup_ns").alias("cell_ns"),
        gain(F.col("fare"), F.col("tip")).alias("gain")).where("gain is not null and not isnan(gain)")


def _gains(trips: DataFrame, sliding: Sliding) -> DataFrame:
    return gains(trips).select(sliding.pane(F.col("ts")).alias("pane"), *CELL, "gain")


def median_profit(
    trips: DataFrame, sliding: Sliding, bands_per_octave: int = BANDS_PER_OCTAVE,
) -> DataFrame:
    """Median gain per sliding window and pickup cell (batch)."""
    return sliding_median(
        _gains(trips, sliding), CELL, "gain", sliding, "profit", bands_per_octave
    ).select(sliding.window_end(F.col("w")).alias("window_end"), *CELL, "profit")


def total_profit(trips: DataFrame, sliding: Sliding) -> DataFrame:
    """Summed gain per sliding window and pickup cell (batch)."""
    panes = (
        _gains(trips, sliding)
        .groupBy("pane", *CELL).agg(F.sum("gain").alias("gain")))
    # One row per pane and cell is left, so a block of a cell is a small group.
    return (
        explode_windows(gather(sliding.to_blocks(panes), "block", *CELL))
        .groupBy("block", "w", *CELL).agg(F.sum("gain").alias("total_profit"))
        .select(sliding.window_end(F.col("w")).alias("window_end"), *CELL, "total_profit"))


def join_profitability(profit: DataFrame, counts: DataFrame, window_key: str) -> DataFrame:
    """Median profit divided by empty taxis, where both exist for a cell and window label.

    Both sides' labels must be the same in every pair; the job fails if they are not.
    """
    counts = counts.withColumn("_label", _label(counts, window_key))
    pairs = profit.join(counts, [window_key, *CELL]).where(F.col("count") != 0)
    return checked(pairs, F.col("_label") == _label(profit, window_key), "a profit joined a count of another window").select(
        window_key, *CELL, profitability(F.col("profit"), F.col("count")).alias("profitability"))


def _label(rows: DataFrame, window_key: str) -> Column:
    """The end of a window, also where the key is a window itself."""
    is_window = isinstance(rows.schema[window_key].dataType, StructType)
    return window_end_ms(F.col(window_key)) if is_window else F.col(window_key)
