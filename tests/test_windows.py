"""Window operators against brute force in Python."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faregrid.operators import median as M
from faregrid.operators.last_dropoff import empty_taxi_count, last_dropoff_by_taxi
from faregrid.operators.panes import Sliding
from faregrid.operators.profit import median_profit, total_profit
from faregrid.plans import profitability as P
from faregrid.plans.distance import trip_distance

A, B, C = (1, 1), (2, 5), (600, 600)


def window_ends(ts_ms, size, slide):
    end = ts_ms // slide * slide + slide
    while end - size <= ts_ms:
        yield end
        end += slide


def random_rows(n, seed, span_ms=400_000, hot=0.0):
    rng = random.Random(seed)
    times = sorted(rng.randrange(-span_ms // 4, span_ms) for _ in range(n))
    cells = [A, B, C, (7, 9)]
    return [(i, t, f"m{rng.randrange(12)}",
             A if rng.random() < hot else rng.choice(cells), rng.choice(cells),
             rng.choice([0, 1, 2.5, 2.5, -3, 1e-9, 1e12, rng.random() * 50]), rng.choice([0, 0.5]))
            for i, t in enumerate(times)]


def brute_profit(rows, size, slide):
    groups = defaultdict(list)
    for _, t, _, pickup, _, fare, tip in rows:
        for end in window_ends(t, size, slide):
            groups[end, *pickup].append(fare + tip)
    return groups


def brute_areas(rows, size=150_000, slide=10_000):
    profit = {k: statistics.median(v) for k, v in brute_profit(rows, size, slide).items()}
    last = {}
    for seq, t, taxi, _, dropoff, _, _ in rows:
        for end in window_ends(t, size, slide):
            last[end, taxi] = max(last.get((end, taxi), (-1, None)), (seq, dropoff))
    taxis = defaultdict(set)
    for (end, taxi), (_, cell) in last.items():
        taxis[end + slide, *cell].add(taxi)
    return {k: v / len(taxis[k]) for k, v in profit.items() if k in taxis}


def as_map(df, value):
    rows = df.collect()
    got = {(r.window_end, r.cell_we, r.cell_ns): r[value] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("size,slide", [(150_000, 10_000), (25_000, 10_000), (30_000, 30_000),
                                        (5_000, 20_000)])
@pytest.mark.parametrize("bands", [1, M.BANDS_PER_OCTAVE, 1024])
def test_median(spark, make_trips, size, slide, bands):
    """Gains in one band, in a few, and nearly each in its own."""
    rows = random_rows(600, seed=size + bands, hot=0.4)
    got = as_map(median_profit(make_trips(rows), Sliding(size, slide), bands), "profit")
    want = brute_profit(rows, size, slide)
    assert got.keys() == want.keys()
    for key, gains in want.items():
        assert got[key] == pytest.approx(statistics.median(gains), rel=1e-12), key


def test_building_a_plan_starts_no_job(spark, make_trips):
    trips = make_trips(random_rows(300, seed=3))
    spark.sparkContext.setJobGroup("plan", "building")
    try:
        P.profitable_areas(trips)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("gains,want", [
    ([1, 2, 4, 10], 3.0), ([5], 5.0), ([float("nan"), 1, 3], 2.0), ([-1, 0, 0, 7], 0.0),
    ([float("inf"), 1, 2], 2.0),
])
@pytest.mark.parametrize("bands", [M.BANDS_PER_OCTAVE, 1024])
def test_median_cases(make_trips, gains, want, bands):
    trips = make_trips([(i, 1000 + i, "m", A, B, g, 0) for i, g in enumerate(gains)])
    got = as_map(median_profit(trips, Sliding(), bands), "profit")
    assert len(got) == 15 and set(got.values()) == {want}


def test_bands_never_decrease(spark):
    values = sorted([0.0, -0.0, 1e-320, -1e-320, 5e-324, 1.7e308, -1.7e308, float("inf"),
                     float("-inf")] + [s * random.Random(1).random() * 10 ** e
                                       for e in range(-9, 9) for s in (1, -1)])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = sorted((r.v, r.b) for r in df.select("v", M.value_band(F.col("v")).alias("b")).collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows)


@pytest.mark.parametrize("size,slide", [(150_000, 10_000), (25_000, 10_000), (5_000, 20_000)])
def test_last_dropoff(make_trips, size, slide):
    rows = random_rows(500, seed=size)
    want = {}
    for seq, t, taxi, _, dropoff, _, _ in rows:
        for end in window_ends(t, size, slide):
            want[end, taxi] = dropoff          # rows are in arrival order
    got = last_dropoff_by_taxi(make_trips(rows), Sliding(size, slide)).collect()
    assert len(got) == len(want)               # one row per taxi and window
    assert {(r.window_end, r.medallion): (r.cell_we, r.cell_ns) for r in got} == want


def test_taxi_counts_once_in_its_last_cell(make_trips):
    trips = make_trips([(0, 1000, "m", A, A, 1, 0), (1, 2000, "m", A, B, 1, 0)])
    got = as_map(empty_taxi_count(last_dropoff_by_taxi(trips, Sliding()), 10_000), "count")
    assert {k[1:] for k in got} == {B}
    assert min(got)[0] == 20_000               # window end 10,000, one slide later
    assert set(got.values()) == {1}


def test_counts_add_up_to_active_taxis(make_trips):
    rows = random_rows(400, seed=5)
    active = defaultdict(set)
    for _, t, taxi, *_ in rows:
        for end in window_ends(t, 150_000, 10_000):
            active[end + 10_000].add(taxi)
    counts = empty_taxi_count(last_dropoff_by_taxi(make_trips(rows), Sliding()), 10_000)
    got = {r.window_end: r.n for r in counts.groupBy("window_end").agg(F.sum("count").alias("n")
                                                                      ).collect()}
    assert got == {end: len(taxis) for end, taxis in active.items()}


def test_total_profit(make_trips):
    rows = random_rows(300, seed=8)
    got = as_map(total_profit(make_trips(rows), Sliding()), "total_profit")
    want = brute_profit(rows, 150_000, 10_000)
    assert got == pytest.approx({k: sum(v) for k, v in want.items()}, abs=1e-3)


@pytest.mark.parametrize("bands", [4, 512])
def test_areas(make_trips, bands):
    rows = random_rows(500, seed=21, hot=0.3)
    got = as_map(P.profitable_areas(make_trips(rows), bands_per_octave=bands), "profitability")
    assert got == pytest.approx(brute_areas(rows))


def test_lag_needs_a_count_one_slide_earlier(make_trips):
    """A lone trip has no count at the first of its windows, one slide on it has."""
    trips = make_trips([(0, 5000, "m", A, A, 4, 1)])
    got = as_map(P.profitable_areas(trips), "profitability")
    assert sorted(k[0] for k in got) == [10_000 * k for k in range(2, 16)]
    assert set(got.values()) == {5.0}


def test_literal_restamped_windows(make_trips):
    """The lag as written: reports stamped with their window's end are windowed again."""
    trips = make_trips(random_rows(400, seed=33))
    profit = median_profit(trips, Sliding())
    last = last_dropoff_by_taxi(trips, Sliding())
    tumble = F.window(F.timestamp_millis("window_end"), "10 seconds")
    counts = (last.groupBy(tumble.alias("slot"), "cell_we", "cell_ns").agg(
        F.count_distinct("medallion").alias("count"),
        F.count_distinct("window_end").alias("ids"))
        .withColumn("label", F.unix_millis("slot.end")))
    assert counts.where("ids <> 1").isEmpty()
    left = profit.withColumn("slot", tumble)
    right = counts.drop("slot").withColumn("slot", F.window(F.timestamp_millis("label"), "10 seconds"))
    joined = left.join(right, ["slot", "cell_we", "cell_ns"])
    assert joined.where("window_end <> label").isEmpty()
    want = {(r.window_end, r.cell_we, r.cell_ns): r.profit / r["count"] for r in joined.collect()}
    assert as_map(P.profitable_areas(trips), "profitability") == want


def test_top_cells(make_trips):
    areas = P.profitable_areas(make_trips(random_rows(300, seed=2)))
    top = P.top_profitable_cells(areas, 2).collect()
    per_window = defaultdict(list)
    for r in areas.collect():
        per_window[r.window_end].append((-r.profitability, r.cell_we, r.cell_ns))
    want = {(end, *cell[1:], i + 1) for end, cells in per_window.items()
            for i, cell in enumerate(sorted(cells)[:2])}
    assert {(r.window_end, r.cell_we, r.cell_ns, r.rank) for r in top} == want


def test_trip_distance(spark):
    nan = float("nan")
    rows = [(0, 0, "VTS", 600, 600, 3.0), (1, 1999, "VTS", 600, 600, 5.0),
            (2, 2000, "VTS", 600, 600, 7.0), (3, 100, "VTS", 600, 600, 1.0),
            (4, 100, "CMT", 600, 600, 9.0), (5, 100, None, 600, 600, 9.0),
            (6, 100, "VTS", 600, 600, nan), (7, 100, "VTS", 0, 600, 9.0)]
    df = spark.createDataFrame(rows, "seq long, ms long, vendor_id string, pickup_cell int, "
                                     "dropoff_cell int, trip_distance double")
    got = trip_distance(df.withColumn("ts", F.timestamp_millis("ms"))).collect()
    assert {(r.window_end, r.cell_id, r["count"], r.avg_trip_distance) for r in got} == {
        (2000, 600, 2, 4.0), (4000, 600, 1, 7.0)}


def test_bad_sliding():
    with pytest.raises(ValueError):
        Sliding(0, 10)
    with pytest.raises(ValueError):
        Sliding(150_000, 10_000, windows_per_block=3)
