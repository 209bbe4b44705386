"""The profitability query on an unbounded stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.functions import grid
from faregrid.functions.scalars import window_end_ms
from faregrid.operators.last_dropoff import named_taxis
from faregrid.operators.median import value_band
from faregrid.operators.panes import Sliding
from faregrid.operators.profit import CELL, gains, join_profitability


def _ms(value: int) -> str:
    return f"{value} milliseconds"


def _windows(sliding: Sliding) -> Column:
    """The windows that hold a closed pane."""
    return F.window("pane", _ms(sliding.size_ms), _ms(sliding.slide_ms)).alias("window")


def stream_median_profit(trips: DataFrame, sliding: Sliding, bands_per_octave: int | None = None) -> DataFrame:
    """Median gain per window and pickup cell. `trips` carries a watermark on `ts`.

    Equal gains of a pane are counted first. A trip thus updates one state row, and only a
    closed pane's distinct gains are copied into the windows that hold the pane. A window's and
    cell's gains are then one state row, unless `bands_per_octave` splits them by value: see
    `stream_split_median`.
    """
    if bands_per_octave is not None:
        return stream_split_median(gains(trips), CELL, "gain", sliding, "profit", bands_per_octave)
    panes = (
        gains(trips)
        .groupBy(F.window("ts", _ms(sliding.pane_ms)).alias("pane"), *CELL, "gain")
        .agg(F.count("*").alias("n")))
    return panes.groupBy(_windows(sliding), *CELL).agg(F.percentile("gain", F.lit(0.5), F.col("n")).alias("profit"))


def stream_split_median(
    rows: DataFrame, keys: list[str], value: str, sliding: Sliding, name: str, bands_per_octave: int,
) -> DataFrame:
    """The same median with state that is split: no state row holds more than one value band of a window
    and its keys, and a hot group's bands lie on many tasks.

    One branch counts each band, with its least and greatest value; the counts of a group, one number per
    band, tell the band that holds the middle rank. The other branch keeps each band's distinct values,
    and the band asked for is joined. Two middle ranks in different bands are neighbours: the greatest
    value of one and the least of the other, so one band is always enough.
    """
    rows = rows.withColumn("band", value_band(F.col(value), bands_per_octave))
    pane = F.window("ts", _ms(sliding.pane_ms)).alias("pane")
    counts = rows.groupBy(pane, *keys, "band").agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    counts = counts.groupBy(_windows(sliding), *keys, "band").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    groups = counts.groupBy("window", *keys).agg(F.array_sort(F.collect_list(F.struct("band", "n", "least", "most"))).alias("bands"))
    total = F.aggregate("bands", F.lit(0).cast("long"), lambda sum_, b: sum_ + b["n"])
    groups = groups.withColumn("low", F.call_function("div", total + 1, F.lit(2).cast("long"))).withColumn(
        "high", F.call_function("div", total, F.lit(2).cast("long")) + 1)

    def holder(rank: str) -> Column:
        """The band of a rank, and how many values lie below it."""
        none = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("band"),
                        F.lit(None).cast("double").alias("least"), F.lit(None).cast("double").alias("most"))
        return F.aggregate("bands", none, lambda at, b: F.when(at["band"].isNotNull(), at).when(
            F.col(rank) <= at["below"] + b["n"],
            F.struct(at["below"].alias("below"), b["band"].alias("band"), b["least"].alias("least"), b["most"].alias("most"))
        ).otherwise(F.struct((at["below"] + b["n"]).alias("below"), at["band"].alias("band"), at["least"].alias("least"), at["most"].alias("most"))))

    groups = groups.withColumn("low_at", holder("low")).withColumn("high_at", holder("high")).select(
        "window", *keys, F.col("low_at.band").alias("band"),
        (F.col("low") - F.col("low_at.below")).alias("low"), (F.col("high") - F.col("low_at.below")).alias("high"),
        F.when(F.col("low_at.band") != F.col("high_at.band"), (F.col("low_at.most") + F.col("high_at.least")) / 2).alias("between"))
    values = rows.groupBy(pane, *keys, "band", value).agg(F.count("*").alias("n"))
    values = values.groupBy(_windows(sliding), *keys, "band").agg(
        F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "n"))).alias("values"))

    def ranked(rank: str) -> Column:
        """The value of a rank inside the band."""
        none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("v"))
        return F.aggregate("values", none, lambda at, x: F.when(at["upto"] >= F.col(rank), at).otherwise(
            F.struct((at["upto"] + x["n"]).alias("upto"), x["v"].alias("v"))))["v"]

    return groups.join(values, ["window", *keys, "band"]).select(
        "window", *keys, F.coalesce("between", (ranked("low") + ranked("high")) / 2).alias(name))


def _last_dropoffs(trips: DataFrame, sliding: Sliding, delay: str) -> DataFrame:
    """The packed cell of the last drop-off per window and taxi, with time moved on by one slide."""
    key = grid.pack_cell(F.col("dropoff_we"), F.col("dropoff_ns"))
    late_by_a_slide = (
        named_taxis(trips)
        .withColumn("ts_lag", F.timestamp_millis(F.unix_millis("ts") + sliding.slide_ms))
        .withWatermark("ts_lag", delay))
    panes = late_by_a_slide.groupBy(
        F.window("ts_lag", _ms(sliding.pane_ms)).alias("pane"), "medallion").agg(
        F.max_by(key, "seq").alias("cell_key"), F.max("seq").alias("seq"))
    return panes.groupBy(_windows(sliding), "medallion").agg(F.max_by("cell_key", "seq").alias("cell_key"))


def stream_last_dropoffs(trips: DataFrame, sliding: Sliding, delay: str = "0 seconds") -> DataFrame:
    """Cell of the last drop-off by arrival (`seq`) per sliding window and taxi."""
    return _last_dropoffs(trips, sliding, delay).select(
        (window_end_ms(F.col("window")) - sliding.slide_ms).alias("window_end"), "medallion",
        grid.packed_we(F.col("cell_key")).alias("cell_we"), grid.packed_ns(F.col("cell_key")).alias("cell_ns"))


def stream_empty_taxis(trips: DataFrame, sliding: Sliding, delay: str = "0 seconds") -> DataFrame:
    """Taxis per last drop-off cell, counted one slide after their window.

    Time is moved on by one slide before windowing. The shifted window is then the join
    key itself, which lets the watermark release the join's state. A trip updates the one state
    row of its pane and taxi; only closed panes are copied into windows.
    """
    return _last_dropoffs(trips, sliding, delay).groupBy(
        "window", grid.packed_we(F.col("cell_key")).alias("cell_we"),
        grid.packed_ns(F.col("cell_key")).alias("cell_ns"),
    ).agg(F.count("*").cast("int").alias("count"))


def stream_total_profit(trips: DataFrame, sliding: Sliding) -> DataFrame:
    """Summed gain per window and pickup cell. `trips` carries a watermark on `ts`."""
    panes = (
        gains(trips).groupBy(F.window("ts", _ms(sliding.pane_ms)).alias("pane"), *CELL)
        .agg(F.sum("gain").alias("gain")))
    totals = panes.groupBy(_windows(sliding), *CELL).agg(F.sum("gain").alias("total_profit"))
    return totals.select(window_end_ms(F.col("window")).alias("window_end"), *CELL, "total_profit")


def stream_profitable_areas(
    trips: DataFrame, sliding: Sliding, delay: str = "0 seconds", state_bands: int | None = None,
) -> DataFrame:
    """Append-mode profitability; every state is released as its window closes.

    `delay` is how far a trip may lie behind the latest one and still count; `state_bands` splits
    the median's state by bands of gains.
    """
    profit = stream_median_profit(trips.withWatermark("ts", delay), sliding, state_bands)
    counts = stream_empty_taxis(trips, sliding, delay)
    areas = join_profitability(profit, counts, "window")
    return areas.select(window_end_ms(F.col("window")).alias("window_end"), *CELL, "profitability")
