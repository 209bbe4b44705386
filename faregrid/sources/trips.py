"""Headerless trip records: text lines in, valid trips on the grid out.

Bad rows are dropped, never fatal: wrong arity, unreadable numbers or times, an end of
the trip outside the grid. All checks are Column expressions over `value`; any other
column of the input (line number, block, arrival time) is carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.functions import grid
from faregrid.functions.scalars import date_time, is_date_time, number, tokens
from faregrid.schema import TRIPS17, TRIPS18, Layout

_POSITIONS = ("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _once(value: Column) -> Column:
    """The value, worked out once per row: a filter behind it stays behind it. Filters are otherwise moved in
    front of the columns they test, each with the whole expression of every column it names."""
    return F.explode(F.array(value))


def _fields(lines: DataFrame, layout: Layout, numeric: tuple[str, ...]) -> DataFrame:
    """Rows of legal arity with their fields as columns; numbers already cast."""
    tok = F.col("tok")
    arity = F.size(tok) == layout.n_tokens if layout.exact else F.size(tok) >= layout.n_tokens
    split = lines.withColumn("tok", _once(tokens(F.col("value")))).drop("value").where(arity)

    def read(name: str, position: int) -> Column:
        token = F.get(tok, F.lit(position))
        return number(token) if name in numeric else token

    fields = F.struct(*(read(name, at).alias(name) for name, at in layout.fields.items()))
    return split.withColumn("tok", _once(fields)).withColumns({name: tok[name] for name in layout.fields}).drop("tok")


def cells_of(rows: DataFrame) -> DataFrame:
    """Coordinates to cell indices, for trips with both ends on the grid.

    Box test first, then cell numbers, then their range.
    """
    boxed = rows.where(
        grid.in_box(F.col("pickup_lat"), F.col("pickup_lon"))
        & grid.in_box(F.col("dropoff_lat"), F.col("dropoff_lon")))
    cells = boxed.withColumns({
        "pickup_we": grid.cell_we(F.col("pickup_lon")),
        "pickup_ns": grid.cell_ns(F.col("pickup_lat")),
        "dropoff_we": grid.cell_we(F.col("dropoff_lon")),
        "dropoff_ns": grid.cell_ns(F.col("dropoff_lat"))}).drop(*_POSITIONS)
    return cells.where(grid.valid_index(
        *(F.col(c) for c in ("pickup_we", "pickup_ns", "dropoff_we", "dropoff_ns"))))


def parse_trips17(lines: DataFrame) -> DataFrame:
    """Trips of the profitability layout (17 or more fields) from column `value`."""
    rows = _fields(lines, TRIPS17, _POSITIONS + ("fare", "tip"))
    rows = rows.where(
        F.col("fare").isNotNull() & F.col("tip").isNotNull()
        & is_date_time(F.col("pickup_datetime")) & is_date_time(F.col("dropoff_datetime")))
    return cells_of(rows).withColumns({
        "pickup_ts": date_time(F.col("pickup_datetime")),
        "dropoff_ts": date_time(F.col("dropoff_datetime")),
    }).drop("pickup_datetime", "dropoff_datetime")


def parse_trips18(lines: DataFrame) -> DataFrame:
    """Trips of the distance layout (exactly 18 fields) from column `value`."""
    rows = _fields(lines, TRIPS18, _POSITIONS + ("trip_distance",))
    return cells_of(rows.where(F.col("trip_distance").isNotNull())).withColumns({
        "pickup_cell": grid.flat_id(F.col("pickup_we"), F.col("pickup_ns")),
        "dropoff_cell": grid.flat_id(F.col("dropoff_we"), F.col("dropoff_ns")),
    }).drop("pickup_we", "pickup_ns", "dropoff_we", "dropoff_ns")


def scan_trips17(spark: SparkSession, path: str) -> DataFrame:
    return parse_trips17(read_lines(spark, path))


def scan_trips18(spark: SparkSession, path: str) -> DataFrame:
    return parse_trips18(read_lines(spark, path))
