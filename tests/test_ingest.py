import pytest
from pyspark.sql import functions as F

from faregrid.sources import blocks, trips as T

GOOD17 = ["m1", "h1", "2013-01-01 00:00:00", "2013-01-01 00:05:00", "300", "1.2",
          "-73.9855", "40.7580", "-73.7781", "40.6413", "CRD", "10.5", "0.5", "0.5", "2.0", "0",
          "13.5"]
GOOD18 = GOOD17[:2] + ["VTS"] + GOOD17[2:]


def line(fields, **changes):
    fields = list(fields)
    for key, value in changes.items():
        fields[int(key[1:])] = value
    return ",".join(fields)


def parse(spark, parser, *lines):
    return parser(spark.createDataFrame([(x,) for x in lines], "value string")).collect()


def test_good_row(spark):
    row, = parse(spark, T.parse_trips17, line(GOOD17))
    assert (row.medallion, row.pickup_we, row.pickup_ns, row.dropoff_we, row.dropoff_ns) == (
        "m1", 414, 320, 506, 372)
    assert (row.fare, row.tip) == (10.5, 2.0)
    row, = parse(spark, T.parse_trips18, line(GOOD18))
    assert (row.vendor_id, row.pickup_cell, row.dropoff_cell, row.trip_distance) == (
        "VTS", 192094, 223334, 1.2)


@pytest.mark.parametrize("text,kept", [
    (line(GOOD17), True),
    (line(GOOD17[:16]), False),
    (line(GOOD17) + ",x", True),
    (line(GOOD17) + ",x,y", True),
    (line(GOOD17, f16=""), False),            # a trailing empty field does not count
    (line(GOOD17, f16="") + ",,", False),
    (line(GOOD17) + ",,", True),
    (line(GOOD17, f15=""), True),
    (line(GOOD17, f11="abc"), False),
    (line(GOOD17, f11=""), False),
    (line(GOOD17, f14="x"), False),
    (line(GOOD17, f11=" 7.5 "), True),
    (line(GOOD17, f11="NaN"), True),
    (line(GOOD17, f11="nan"), False),
    (line(GOOD17, f7="NaN"), False),
    (line(GOOD17, f6="40.7580", f7="-73.9855"), False),
    (line(GOOD17, f8="0", f9="0"), False),
    (line(GOOD17, f2="soon"), False),
    (line(GOOD17, f3=""), False),
    (line(GOOD17, f2="2013-13-40 25:61:61"), True),   # lenient: only the shape counts
    (line(GOOD17, f2="2013-1-1 0:0:0.5 late"), True),
    ("", False), (",,,,,,,,,,,,,,,,,,", False),
])
def test_trips17(spark, text, kept):
    assert len(parse(spark, T.parse_trips17, text)) == kept


@pytest.mark.parametrize("text,kept", [
    (line(GOOD18), True),
    (line(GOOD18) + ",x", False),
    (line(GOOD18) + ",,", True),
    (line(GOOD18, f17=""), False),
    (line(GOOD18, f6="far"), False),
    (line(GOOD18, f6="NaN"), True),           # the query's filter removes it
    (line(GOOD18, f2=""), True),
    (line(GOOD18, f3="never", f12="abc"), True),
    (line(GOOD18, f7="-74.91470915200739", f8="41.4760611520074"), False),
])
def test_trips18(spark, text, kept):
    assert len(parse(spark, T.parse_trips18, text)) == kept


@pytest.mark.parametrize("split_bytes", ["134217728", "500"])
def test_line_numbers(spark, tmp_path, split_bytes):
    """Numbers follow file and line order, however the files are split."""
    want = []
    for part in range(3):
        lines = [f"{part}-{i}" + "x" * (i % 37) for i in range(100 * (3 - part))]
        (tmp_path / f"part-{part}").write_text("\n".join(lines) + "\n")
        want += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = blocks.number_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line_no for r in got] == list(range(len(want)))
    assert [r.value for r in got] == want


def test_bad_lines_use_up_the_quota(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "trips").write_text(
        "\n".join(line(GOOD17, f0=f"m{i}") if i % 4 else "junk" for i in range(10)))
    lines = blocks.read_blocks(spark, str(tmp_path / "in"), 5, instances=2)
    got = blocks.cached_events(T.parse_trips17(lines)).orderBy("line_no").collect()
    assert [(r.block_id, r.line_no, r.cache_idx, r.cache_n, r.medallion) for r in got] == [
        (0, 1, 0, 3, "m1"), (0, 2, 1, 3, "m2"), (0, 3, 2, 3, "m3"),
        (1, 5, 0, 4, "m5"), (1, 6, 1, 4, "m6"), (1, 7, 2, 4, "m7"), (1, 9, 3, 4, "m9")]
    assert blocks.read_blocks(spark, str(tmp_path / "in"), 5, instances=1).agg(
        F.max("line_no")).first()[0] == 4
