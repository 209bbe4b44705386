import pytest
from pyspark.sql import functions as F

from faregrid.functions import grid, scalars

POINTS = [  # name, lat, lon, in box, we, ns, flat id, packed key, kept
    ("first", 41.474937, -74.913585, True, 1, 1, 600, 65537, True),
    ("square", 40.7580, -73.9855, True, 414, 320, 192094, 27132224, True),
    ("airport", 40.6413, -73.7781, True, 506, 372, 223334, 33161588, True),
    ("nw", 41.4760611520074, -74.91470915200739, True, 0, 0, None, None, False),
    ("se", 40.1270787431293, -73.56572674312929, True, 601, 600, None, None, False),
    ("ne", 41.4760601520074, -73.56572774312929, True, 600, 1, 1199, 39321601, True),
    ("zero", 0.0, 0.0, False, None, None, None, None, False),
    ("nan", float("nan"), -74.0, False, None, None, None, None, False),
    ("far", 1e300, -1e300, False, None, None, None, None, False),
]


def test_constants():
    assert (grid.O_LAT, grid.O_LON) == (41.4760611520074, -74.91470915200739)
    assert (grid.S_LAT, grid.NE_LON) == (40.1270787431293, -73.56572674312929)


def test_points(spark):
    lat, lon = F.col("lat"), F.col("lon")
    df = spark.createDataFrame([p[:3] for p in POINTS], "name string, lat double, lon double")
    got = {r["name"]: r for r in df.select(
        "name", grid.in_box(lat, lon).alias("box"), grid.in_grid(lat, lon).alias("kept"),
        grid.cell_we(lon).alias("we"), grid.cell_ns(lat).alias("ns"),
        grid.cell_flat_id(lat, lon).alias("flat"), grid.cell_text_id(lat, lon).alias("text"),
        grid.pack_cell(grid.cell_we(lon), grid.cell_ns(lat)).alias("key")).collect()}
    for name, _, _, box, we, ns, flat, key, kept in POINTS:
        row = got[name]
        assert (row["box"], row["kept"], row["flat"]) == (box, kept, flat), name
        if we is not None:
            assert (row["we"], row["ns"]) == (we, ns), name
        assert row["text"] == (f"{we}.{ns}" if kept else None)
        if kept:
            assert row["key"] == key


def test_flat_ids_collide(spark):
    row = spark.range(1).select(
        grid.flat_id(F.lit(600), F.lit(1)).alias("a"), grid.flat_id(F.lit(1), F.lit(2)).alias("b"),
        grid.packed_we(grid.pack_cell(F.lit(600), F.lit(7))).alias("we"),
        grid.packed_ns(grid.pack_cell(F.lit(600), F.lit(7))).alias("ns")).first()
    assert row["a"] == row["b"] == 1199
    assert (row["we"], row["ns"]) == (600, 7)


@pytest.mark.parametrize("text,want", [
    ("1.5", 1.5), (" 1.5 ", 1.5), ("1.5d", 1.5), ("-2e3", -2000.0), ("abc", None), ("", None),
    ("nan", None), ("inf", None), ("infinity", None), ("Infinity", float("inf")),
])
def test_number(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scalars.number(F.col("t"))).first()[0] == want


def test_nan_literal(spark):
    df = spark.createDataFrame([("NaN",)], "t string")
    assert df.select(F.isnan(scalars.number(F.col("t")))).first()[0]
