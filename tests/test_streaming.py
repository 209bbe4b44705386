import contextlib
import io
import json

import pytest
from pyspark.sql import functions as F

from faregrid import schema as S
from faregrid.operators import throughput
from faregrid.operators.median import value_band
from faregrid.operators.panes import Sliding
from faregrid.operators.profit import median_profit
from faregrid.plans import profitability as P
from faregrid.plans.distance import trip_distance
from faregrid.sources import replay as R
from faregrid.sources.driver_tables import trips
from faregrid.sources.trips import parse_trips18
from faregrid.streaming import runs, state
from faregrid.streaming.profitability import stream_empty_taxis, stream_median_profit


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_distance_stream_equals_batch(spark, sf_dir):
    table = trips(spark, sf_dir)
    streamed = runs.drain(spark, table, S.DISTANCE_TRIP, trip_distance, slices=3)
    mean = F.round("avg_trip_distance", 9)
    assert rows(streamed.withColumn("avg_trip_distance", mean)) == rows(
        trip_distance(table).withColumn("avg_trip_distance", mean))


def test_state_partitions_are_bounded(spark, sf_dir, tmp_path):
    """A session set for large tables: the state has a few partitions per core, the setting stays."""
    arrived, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    trips(spark, sf_dir).select(*(F.col(f.name).cast(f.dataType) for f in S.DISTANCE_TRIP.fields)).write.parquet(arrived)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        runs.run_available(trip_distance(runs.read_stream(spark, arrived, S.DISTANCE_TRIP)), out, checkpoint)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "60"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.numPartitions for r in state.operators(spark, checkpoint).collect()} == {4 * spark.sparkContext.defaultParallelism}


def test_slices_are_bounded_and_hold_every_trip_once(spark, sf_dir):
    table = trips(spark, sf_dir)
    n = table.count()
    parts = [part.agg(F.count("*"), F.min("ts"), F.max("ts")).first() for part in runs.time_slices(table, 2, n // 5)]
    assert len(parts) >= 5 and sum(p[0] for p in parts) == n
    assert all(a[2] < b[1] for a, b in zip(parts, parts[1:]))
    assert len(runs.time_slices(table, 2)) == 2 and runs.time_slices(table.limit(0), 2) == []


def test_areas_stream_equals_batch_and_frees_its_state(spark, sf_dir, tmp_path):
    table = trips(spark, sf_dir)
    fields = [F.col(f.name).cast(f.dataType) for f in S.FARE_TRIP.fields]
    arrived, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    table.select(*fields).write.parquet(arrived)
    runs.run_available(
        P.profitable_areas(runs.read_stream(spark, arrived, S.FARE_TRIP)), out, state)
    first = spark.read.parquet(out).count()
    runs.sentinel(spark, S.FARE_TRIP).write.mode("append").parquet(arrived)
    query = runs.run_available(
        P.profitable_areas(runs.read_stream(spark, arrived, S.FARE_TRIP)), out, state)
    want = rows(P.profitable_areas(table))
    assert first < len(want)        # the tail waits for the watermark
    assert rows(spark.read.parquet(out)) == want
    join = [op for op in query.lastProgress["stateOperators"]
            if op["operatorName"] == "symmetricHashJoin"]
    assert join and sum(op["numRowsTotal"] for op in join) == 0


def test_all_progress_is_kept(spark, tmp_path):
    """More micro-batches than Spark itself remembers."""
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    log = runs.ProgressLog(spark, str(tmp_path / "progress"))
    try:
        for k in range(12):
            spark.range(k * 10, k * 10 + k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = runs.discard_stream(stream, str(tmp_path / "state"), "many", availableNow=True)
        query.awaitTermination()
        log.wait_for(query)
        samples = runs.progress_samples(log.close()).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert sorted(r.sample_no for r in samples) == list(range(12)) and {r.query_id for r in samples} == {"many"}
    steady = throughput.steady_state(spark.createDataFrame(samples), ["query_id"]).first().steady_rate
    assert steady == pytest.approx(sum(r.rate for r in samples if 0 < r.sample_no < 11) / 10)


def late_case(spark, tmp_path, delay):
    arrived, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    log = runs.ProgressLog(spark, str(tmp_path / "progress"))

    def arrive(*ms):
        spark.createDataFrame(
            [(m, m, "VTS", 600, 600, 2.0) for m in ms],
            "seq long, ms long, vendor_id string, pickup_cell int, dropoff_cell int, "
            "trip_distance double").select(
                *(F.col(f.name) if f.name != "ts" else F.timestamp_millis("ms").alias("ts")
                  for f in S.DISTANCE_TRIP.fields)).coalesce(1).write.mode("append").parquet(arrived)
        return runs.run_available(
            trip_distance(runs.read_stream(spark, arrived, S.DISTANCE_TRIP), delay=delay), out, state)

    queries = [arrive(100, 1900, 4100), arrive(500, 8100), arrive(30_000)]
    log.wait_for(*queries)
    late = runs.late_groups(log.close()).agg(F.sum("late_groups")).first()[0]
    return late, [tuple(r) for r in spark.read.parquet(out).orderBy("window_end").collect()]


def test_late_rows_are_dropped_by_group(spark, tmp_path):
    late, areas = late_case(spark, tmp_path, "0 seconds")   # 500 ms is in a reported window
    assert late == 1 and areas == [(2000, 600, 2, 2.0), (6000, 600, 1, 2.0), (10_000, 600, 1, 2.0)]


def test_a_delay_keeps_late_rows(spark, tmp_path):
    late, areas = late_case(spark, tmp_path, "10 seconds")
    assert late == 0 and areas == [(2000, 600, 3, 2.0), (6000, 600, 1, 2.0), (10_000, 600, 1, 2.0)]


def test_delay_reaches_both_branches_of_the_areas(spark, tmp_path):
    """A trip behind the watermark counts for profit and for its taxi if the delay allows it."""
    rows = [(1, 60_000, "a", 5.0), (2, 1_000_000, "b", 7.0), (3, 61_000, "c", 9.0)]
    want = {}
    for delay in ("0 seconds", "1000 seconds"):
        base = tmp_path / delay.split()[0]
        for k, (seq, ms, taxi, fare) in enumerate(rows):
            df = spark.createDataFrame([(seq, ms, taxi, 5, 5, 5, 5, fare, 0.0)],
                                       "seq long, ms long, medallion string, pickup_we int, pickup_ns int, dropoff_we int, "
                                       "dropoff_ns int, fare double, tip double").withColumn("ts", F.timestamp_millis("ms"))
            df.select(*(F.col(f.name).cast(f.dataType) for f in S.FARE_TRIP.fields)).write.mode("append").parquet(str(base / "in"))
            runs.run_available(P.profitable_areas(runs.read_stream(spark, str(base / "in"), S.FARE_TRIP), delay=delay),
                               str(base / "out"), str(base / "state"))
        runs.sentinel(spark, S.FARE_TRIP).write.mode("append").parquet(str(base / "in"))
        runs.run_available(P.profitable_areas(runs.read_stream(spark, str(base / "in"), S.FARE_TRIP), delay=delay),
                           str(base / "out"), str(base / "state"))
        want[delay] = {r.window_end: r.profitability for r in spark.read.parquet(str(base / "out")).collect()}
    assert want["0 seconds"][100_000] == 5.0 and want["1000 seconds"][100_000] == 7.0 / 2


def test_nulls_are_the_same_in_batch_and_stream(spark):
    rows = [(1, 1000, "a", 5, 5, 5, 5, 3.0, 1.0), (2, 2000, None, 5, 5, 5, 5, 4.0, 1.0), (3, 3000, "b", 5, 5, 5, 5, None, 1.0),
            (4, 4000, "c", 5, 5, 5, 5, float("nan"), 0.0), (5, 5000, "d", 6, 6, 5, 5, None, None)]
    table = spark.createDataFrame(
        rows, "seq long, ms long, medallion string, pickup_we int, pickup_ns int, dropoff_we int, dropoff_ns int, "
        "fare double, tip double").withColumn("ts", F.timestamp_millis("ms"))
    for query in (P.profitable_areas, P.total_profit_by_cell):
        want = query(table).collect()
        assert sorted(map(tuple, runs.drain(spark, table, S.FARE_TRIP, query).collect())) == sorted(map(tuple, want))
        assert want and not any(None in r for r in want)


def test_lines_that_arrive_now(spark, tmp_path):
    """Text, parsed and stamped with the clock, then the distance query."""
    line = ",".join(["m", "h", "VTS", "d", "d", "60", "2.5", "-73.99", "40.75", "-73.98", "40.76", "CRD", "1", "0", "0", "1", "0", "1.0"])
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"{line}\nbad,line\n" * (k + 1))
    trips = runs.arriving_lines(spark, str(tmp_path / "in"), parse_trips18)
    query = runs.run_available(trips, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.where("ts is null or seq is null").count() == 0
    assert query.exception() is None and trip_distance(trips).isStreaming


def test_taxis_are_reduced_to_panes_before_windows(spark, sf_dir, tmp_path):
    """Trips are aggregated below the step that copies rows into windows."""
    fields = [F.col(f.name).cast(f.dataType) for f in S.FARE_TRIP.fields]
    trips(spark, sf_dir).limit(50).select(*fields).write.parquet(str(tmp_path / "in"))
    stream = runs.read_stream(spark, str(tmp_path / "in"), S.FARE_TRIP)
    query = runs.discard_stream(stream_empty_taxis(stream, Sliding()), str(tmp_path / "state"), "taxis", availableNow=True)
    query.awaitTermination()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        query.explain()
    plan = text.getvalue()
    assert "max_by" in plan[plan.rindex("Expand"):]


def test_live_replay_and_replicas(spark, tmp_path):
    cached = spark.range(50).select(
        F.col("id").alias("cache_idx"), F.lit("VTS").alias("vendor_id"),
        F.lit(600).alias("pickup_cell"), F.lit(600).alias("dropoff_cell"),
        (F.col("id") + 2.0).alias("trip_distance"))
    log = runs.ProgressLog(spark, str(tmp_path / "progress"))
    queries = runs.start_replicas(
        lambda i: R.live_replay(spark, cached, 200), trip_distance, 2, str(tmp_path / "state"),
        processingTime="1 second")
    try:
        assert {q.name for q in queries} == {"query_0", "query_1"}
        for query in queries:
            for _ in range(60):
                if any(p["numInputRows"] for p in query.recentProgress):
                    break
                query.awaitTermination(1)
    finally:
        for query in queries:
            query.stop()
        log.wait_for(*queries)
        samples = runs.progress_samples(log.close()).collect()
    assert {r.query_id for r in samples} == {"query_0", "query_1"} and all(r.rate > 0 for r in samples)


def test_a_batch_that_is_run_again_is_one_sample(spark, tmp_path):
    """Killed behind its work and before its commit, a micro-batch is repeated after the restart."""
    log = runs.ProgressLog(spark, str(tmp_path / "progress"), every=1)
    arrived, state_dir = str(tmp_path / "in"), tmp_path / "state"

    def run(n):
        spark.range(n).write.mode("append").parquet(arrived)
        query = runs.discard_stream(runs.read_stream(spark, arrived, "id long"), str(state_dir), "again", availableNow=True)
        query.awaitTermination()
        log.wait_for(query)
    run(10)
    run(20)
    (state_dir / "commits" / "1").unlink()
    (state_dir / "commits" / ".1.crc").unlink(missing_ok=True)
    run(30)
    table = log.close()
    assert table.where("batch = 1").count() == 2
    rows = sorted((r.batch, r.rows) for r in runs.progress_rows(table).collect())
    assert rows == [(0, 10), (1, 20), (2, 30)]
    assert [tuple(r) for r in runs.progress_totals(table).collect()] == [("again", 60)]
    marks = sorted((r.total, r.t_ms) for r in runs.progress_checkpoints(table).collect())
    assert [m[0] for m in marks] == [0, 10, 30, 60] and [m[1] for m in marks] == sorted(m[1] for m in marks)
    # Rows that are written twice count once, too.
    assert runs.progress_rows(table.unionAll(table)).count() == 3


def test_a_lost_end_is_an_error(spark, tmp_path):
    log = runs.ProgressLog(spark, str(tmp_path / "progress"))
    try:
        with pytest.raises(TimeoutError):
            log.wait_for(type("Stopped", (), {"runId": "never"})(), seconds=0.2)
    finally:
        assert log.close().count() == 0


def hot_cell(spark, n):
    """Many different gains of one cell: negative, equal, zero and of very different size."""
    return spark.range(n).select(
        F.col("id").alias("seq"), F.timestamp_millis(F.col("id") * (160_000 // n)).alias("ts"), F.lit("m").alias("medallion"),
        F.lit(5).alias("pickup_we"), F.lit(6).alias("pickup_ns"), F.lit(5).alias("dropoff_we"), F.lit(6).alias("dropoff_ns"),
        F.expr("case id % 7 when 0 then -exp(id % 30) when 1 then 0.0 when 2 then 3.5 else pow(1.01, (id * 7) % 500) end").alias("fare"),
        F.lit(0.0).alias("tip"))


def test_split_medians_equal_batch(spark, tmp_path):
    sliding, table = Sliding(20_000, 10_000), hot_cell(spark, 4000)

    def query(t):
        return stream_median_profit(t.withWatermark("ts", "0 seconds"), sliding, 4).select(
            F.unix_millis("window.end").alias("w"), "profit")
    want = {r.window_end: r.profit for r in median_profit(table, sliding).collect()}
    got = runs.drain(spark, table, S.FARE_TRIP, query).collect()
    assert {r.w: r.profit for r in got} == {w: pytest.approx(p) for w, p in want.items()}
    assert len(got) == len(want) > 10


def test_no_state_row_is_over_one_band(spark, tmp_path):
    sliding = Sliding(20_000, 10_000)
    table = hot_cell(spark, 4000)
    arrived, kept = str(tmp_path / "in"), str(tmp_path / "state")
    table.select(*(F.col(f.name).cast(f.dataType) for f in S.FARE_TRIP.fields)).write.parquet(arrived)
    stream = runs.read_stream(spark, arrived, S.FARE_TRIP).withWatermark("ts", "0 seconds")
    runs.run_available(stream_median_profit(stream, sliding, 4).drop("window"), str(tmp_path / "out"), kept)
    # Lists are bytes in a state row, shown in base 64: four characters for three bytes.
    sizes = [len(r.value) * 3 // 4 for r in state.live_rows(spark, kept).collect()]
    bands = table.groupBy(value_band(F.col("fare"), 4).alias("band")).agg(F.count_distinct("fare").alias("n"))
    entries = max(2 * bands.agg(F.max("n")).first()[0], bands.count())  # two panes of a band; or all bands' counts
    window = table.groupBy(F.window("ts", "20 seconds")).agg(F.count_distinct("fare").alias("n")).agg(F.max("n")).first()[0]
    assert max(sizes) <= 60 * entries + 200 and entries < window


def test_replicas_have_pools_of_their_own(spark, tmp_path):
    seen = []
    spark.range(5).write.parquet(str(tmp_path / "in"))

    def start(result, checkpoint, name):
        def note(batch, _):
            seen.append((name, batch.sparkSession.sparkContext.getLocalProperty("spark.scheduler.pool")))
        return result.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    for query in runs.start_replicas(lambda i: runs.read_stream(spark, str(tmp_path / "in"), "id long"), lambda t: t, 3,
                                     str(tmp_path / "state"), start):
        query.awaitTermination()
    assert {name for name, _ in seen} == {"query_0", "query_1", "query_2"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
