"""Sliding windows over bounded data, cut into panes and blocks.

A *pane* is the longest slice of time that never straddles a window border, so rows
are aggregated once per pane before any row is copied into the windows that hold it.

A *block* is a run of `block_slides` consecutive windows. Pane rows are sent to the
block (now and then two) whose windows they touch. Everything a window needs is then
in one partition, and the copying into windows happens there, after the shuffle,
instead of before it. Blocks also bound groups in time: no group spans the whole data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_div(value: Column, step: int) -> Column:
    """Integer division that rounds down, also before 1970."""
    return F.call_function("div", value - F.pmod(value, F.lit(step)), F.lit(step))


@dataclass(frozen=True)
class Sliding:
    """Windows of `size_ms` that end at every multiple of `slide_ms`."""

    size_ms: int = 150_000
    slide_ms: int = 10_000
    windows_per_block: int | None = None

    def __post_init__(self) -> None:
        if self.size_ms <= 0 or self.slide_ms <= 0:
            raise ValueError("window size and slide must be positive")
        if self.windows_per_block is not None and self.windows_per_block * self.slide_ms < self.size_ms:
            raise ValueError("a block must be as long as a window")

    @property
    def block_slides(self) -> int:
        """By default eight times a window's reach: an eighth of the panes go to two blocks."""
        return self.windows_per_block or 8 * -(-self.size_ms // self.slide_ms)

    @property
    def pane_ms(self) -> int:
        return math.gcd(self.size_ms, self.slide_ms)

    def pane(self, ts: Column) -> Column:
        return floor_div(F.unix_millis(ts), self.pane_ms)

    def first_window(self, pane: Column) -> Column:
        """Number of the first window that holds a pane; window w ends at w * slide."""
        return floor_div(pane * self.pane_ms + (self.pane_ms + self.slide_ms - 1), self.slide_ms)

    def last_window(self, pane: Column) -> Column:
        return floor_div(pane * self.pane_ms + self.size_ms, self.slide_ms)

    def window_end(self, window: Column) -> Column:
        return window * self.slide_ms

    def first_block(self, pane: Column) -> Column:
        return floor_div(self.first_window(pane), self.block_slides)

    def to_blocks(self, panes: DataFrame) -> DataFrame:
        """Adds `block`, and the windows `w_from..w_to` of that block the pane belongs to."""
        first, last = self.first_window(F.col("pane")), self.last_window(F.col("pane"))
        size = self.block_slides
        spread = panes.withColumns({"w_from": first, "w_to": last})
        if self.size_ms < self.slide_ms:  # gaps between windows: some panes belong to none
            spread = spread.where("w_from <= w_to")
        spread = spread.withColumn("block", F.explode(F.sequence(
            floor_div(F.col("w_from"), size), floor_div(F.col("w_to"), size))))
        return spread.withColumns({
            "w_from": F.greatest("w_from", F.col("block") * size),
            "w_to": F.least("w_to", F.col("block") * size + (size - 1)),
        })


def gather(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions by `keys` into the session's number of shuffle partitions.

    The number is given on purpose: without it AQE would merge partitions by their size
    at the shuffle, before the rows are copied into their windows.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *keys)


def explode_windows(rows: DataFrame) -> DataFrame:
    """One row per window of `w_from..w_to`, numbered `w`."""
    return rows.select("*", F.explode(F.sequence("w_from", "w_to")).alias("w")).drop(
        "w_from", "w_to")
