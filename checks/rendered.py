"""Text inputs rendered from the `events` table: trip files with damaged rows, and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.functions.grid import O_LAT, O_LON
from faregrid.session import scratch_dir
from faregrid.sources.driver_tables import raw_trips, read_events

# What happens to a row, by event_id % 50; all other rows stay as they are.
SHORT, BAD_FARE, NO_LAT, SWAPPED, BAD_DATE = 0, 1, 2, 3, 4
ODD_DATE, LOWER_NAN, EXTRA_FIELD, BLANKS, ORIGIN, EMPTY_LINE, BAD_DISTANCE = 5, 6, 7, 8, 9, 10, 11
DROPPED_17 = (SHORT, BAD_FARE, NO_LAT, SWAPPED, BAD_DATE, LOWER_NAN, ORIGIN, EMPTY_LINE)
DROPPED_18 = (SHORT, NO_LAT, SWAPPED, EXTRA_FIELD, ORIGIN, EMPTY_LINE, BAD_DISTANCE)


def _damaged(column, *cases: tuple[int, object]):
    for kind, value in cases:
        column = F.when(F.col("seq") % 50 == kind,
                        value if not isinstance(value, str) else F.lit(value)).otherwise(column)
    return column


def trip_lines(events: DataFrame, vendor: bool) -> DataFrame:
    """`seq` and one CSV line per event, in the 17- or the 18-field layout."""
    t = raw_trips(events)
    text = {name: F.col(name).cast("string") for name in (
        "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "fare", "tip", "trip_distance")}
    date = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    fields = [
        F.col("medallion"), F.concat(F.lit("h"), F.col("seq")),
        *([F.col("vendor_id")] if vendor else []),
        _damaged(date, (BAD_DATE, "yesterday"), (ODD_DATE, "2013-13-1 7:05:00.0")), date,
        F.lit("600"),
        _damaged(text["trip_distance"], (BAD_DISTANCE, "far")),
        _damaged(text["pickup_lon"], (SWAPPED, text["pickup_lat"]), (ORIGIN, repr(O_LON))),
        _damaged(text["pickup_lat"], (SWAPPED, text["pickup_lon"]), (NO_LAT, ""),
                 (ORIGIN, repr(O_LAT))),
        text["dropoff_lon"], text["dropoff_lat"], F.lit("CRD"),
        _damaged(text["fare"], (BAD_FARE, "abc"), (LOWER_NAN, "nan"),
                 (BLANKS, F.concat(F.lit(" "), text["fare"], F.lit(" ")))),
        F.lit("0.5"), F.lit("0.5"), text["tip"], F.lit("0"),
        _damaged(F.lit("1.0"), (SHORT, ""), (EXTRA_FIELD, "1.0,x")),
    ]
    return t.select("seq", _damaged(F.concat_ws(",", *fields), (EMPTY_LINE, "")).alias("value"))


def write_trips(spark: SparkSession, sf_dir: str, vendor: bool) -> str:
    """A folder of text files whose lines are the events in order."""
    path = scratch_dir(spark, "trips18" if vendor else "trips17")
    trip_lines(read_events(spark, sf_dir), vendor).orderBy("seq").select("value").write.text(path)
    return path


def last_line(spark: SparkSession, vendor: bool) -> DataFrame:
    """One stamped line far in the future, on the grid, that closes every window before it."""
    spot = f"{O_LON + 0.1},{O_LAT - 0.1},{O_LON + 0.1},{O_LAT - 0.1}"
    date = "2200-01-01 00:00:00"
    fields = ["end-of-stream", "h", *(["VTS"] if vendor else []), date, date, "1", "9", spot, "CRD", "1", "0", "0", "1", "0", "1.0"]
    return spark.createDataFrame([(f"7258118400000\t{2 ** 62}\t{','.join(fields)}",)], "value string")


def write_logs(spark: SparkSession, sf_dir: str) -> str:
    """Run folders of throughput logs; runs of `signup` events have no steady-state line."""
    path = scratch_dir(spark, "logs")
    subtask = F.concat(F.lit("Subtask "), F.col("event_id"))
    steady = F.concat(subtask, F.lit(" Steady-State Average Throughput (events/sec): "),
                      (F.col("value") * F.lit(1e6)).cast("string"))
    sample = F.concat(F.lit("Sample 1: "), F.col("value").cast("string"))
    silent = (F.col("event_id") % 10 == 3) | (F.col("event_type") == "signup")
    (read_events(spark, sf_dir).select(
        F.concat(F.lit("r"), F.expr("event_id div 500 * 10"), F.when(silent, "s").otherwise("")
                 ).alias("run"),
        F.when(silent, sample).otherwise(steady).alias("value"))
     .write.partitionBy("run").text(path))
    return path
