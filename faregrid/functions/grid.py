"""The city grid: 600 x 600 cells of 0.25 km, as Column expressions.

Distances ignore the cosine of the latitude; that is part of the cell definition.
Cell ids depend on the last bit at cell borders, so the degree/radian factors are
literals and the order of operations is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid model.
EARTH_RADIUS_KM = 6371.0
GRID_KM = 150.0
CELL_KM = 0.25
MIN_CELL, MAX_CELL = 1, 600
FIRST_CELL_LAT, FIRST_CELL_LON = 41.474937, -74.913585
DEG_PER_RAD = 57.29577951308232
RAD_PER_DEG = 0.017453292519943295


def shifted(degrees, km):
    """A coordinate moved by so many kilometres: north or east if positive (number or Column)."""
    return degrees + km / EARTH_RADIUS_KM * DEG_PER_RAD


def axis_km(a, b) -> Column:
    """Kilometres between two coordinates of one axis."""
    return F.abs((b - a) * RAD_PER_DEG * EARTH_RADIUS_KM)


# Corners, folded to plain numbers here so that plans carry literals only.
O_LAT, O_LON = shifted(FIRST_CELL_LAT, CELL_KM / 2), shifted(FIRST_CELL_LON, -CELL_KM / 2)
S_LAT, NE_LON = shifted(O_LAT, -GRID_KM), shifted(O_LON, GRID_KM)


def cell_we(lon: Column) -> Column:
    """West-east index of a longitude, counted from 1."""
    return F.ceil(axis_km(F.lit(O_LON), lon) / CELL_KM).try_cast("int")


def cell_ns(lat: Column) -> Column:
    """North-south index of a latitude, counted from 1."""
    return F.ceil(axis_km(F.lit(O_LAT), lat) / CELL_KM).try_cast("int")


def in_box(lat: Column, lon: Column) -> Column:
    """Inside the bounding box, borders included (NaN is outside)."""
    return lat.between(S_LAT, O_LAT) & lon.between(O_LON, NE_LON)


def valid_index(*indices: Column) -> Column:
    test = F.lit(True)
    for index in indices:
        test = test & index.between(MIN_CELL, MAX_CELL)
    return test


def in_grid(lat: Column, lon: Column) -> Column:
    """In the box and on a numbered cell (the exact origin has index 0)."""
    # `when` keeps far-off coordinates away from the int cast.
    return F.when(in_box(lat, lon), valid_index(cell_we(lon), cell_ns(lat))).otherwise(False)


def text_id(we: Column, ns: Column) -> Column:
    return F.concat_ws(".", we, ns)


def flat_id(we: Column, ns: Column) -> Column:
    """`ns * 599 + we`. Not unique: (600, 1) and (1, 2) share an id, and so do their rows."""
    return ns * (MAX_CELL - 1) + we


def cell_text_id(lat: Column, lon: Column) -> Column:
    """`we.ns`, NULL outside the grid."""
    return F.when(in_grid(lat, lon), text_id(cell_we(lon), cell_ns(lat)))


def cell_flat_id(lat: Column, lon: Column) -> Column:
    """Flat cell id, NULL outside the grid."""
    return F.when(in_grid(lat, lon), flat_id(cell_we(lon), cell_ns(lat)))


def pack_cell(we: Column, ns: Column) -> Column:
    """Both indices in one int key."""
    return F.shiftleft(we, 16).bitwiseOR(ns.bitwiseAND(F.lit(0xFFFF)))


def packed_we(key: Column) -> Column:
    return F.shiftrightunsigned(key, 16)


def packed_ns(key: Column) -> Column:
    return key.bitwiseAND(F.lit(0xFFFF))
