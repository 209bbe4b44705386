"""Input layouts and record schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """Where a headerless CSV keeps its fields (0-based), and which arity is legal."""

    n_tokens: int
    exact: bool
    fields: dict[str, int]


# Positions read from the two input layouts.
TRIPS17 = Layout(17, exact=False, fields={
    "medallion": 0, "pickup_datetime": 2, "dropoff_datetime": 3,
    "pickup_lon": 6, "pickup_lat": 7, "dropoff_lon": 8, "dropoff_lat": 9,
    "fare": 11, "tip": 14,
})
TRIPS18 = Layout(18, exact=True, fields={
    "vendor_id": 2, "trip_distance": 6,
    "pickup_lon": 7, "pickup_lat": 8, "dropoff_lon": 9, "dropoff_lat": 10,
})


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_I, _L, _D, _S, _TS = (T.IntegerType(), T.LongType(), T.DoubleType(),
                       T.StringType(), T.TimestampType())

# One ride of the profitability query. `seq` is the arrival order, `ts` the arrival time.
FARE_TRIP = _struct(
    ("seq", _L), ("ts", _TS), ("medallion", _S),
    ("pickup_we", _I), ("pickup_ns", _I), ("dropoff_we", _I), ("dropoff_ns", _I),
    ("fare", _D), ("tip", _D))
# One ride of the distance query.
DISTANCE_TRIP = _struct(
    ("seq", _L), ("ts", _TS), ("vendor_id", _S),
    ("pickup_cell", _I), ("dropoff_cell", _I), ("trip_distance", _D))

PROFIT = _struct(("window_end", _L), ("cell_we", _I), ("cell_ns", _I), ("profit", _D))
LAST_DROPOFF = _struct(("window_end", _L), ("medallion", _S), ("cell_we", _I), ("cell_ns", _I))
TAXI_COUNT = _struct(("window_end", _L), ("cell_we", _I), ("cell_ns", _I), ("count", _I))
PROFITABILITY = _struct(
    ("window_end", _L), ("cell_we", _I), ("cell_ns", _I), ("profitability", _D))
DISTANCE = _struct(
    ("window_end", _L), ("cell_id", _I), ("count", _L), ("avg_trip_distance", _D))
RUN_TOTAL = _struct(("run", _S), ("total_throughput", _D))
