"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from checks import rendered
from faregrid import schema as S
from faregrid.functions import grid
from faregrid.operators import throughput
from faregrid.operators.last_dropoff import empty_taxi_count, last_dropoff_by_taxi
from faregrid.operators.panes import Sliding
from faregrid.operators.profit import median_profit
from faregrid.plans import profitability as P
from faregrid.plans.distance import replicated_distance, trip_distance
from faregrid.plans.summary import throughput_summary
from faregrid.sinks import reports
from faregrid.sources import blocks, replay, trips as T
from faregrid.session import scratch_dir
from faregrid.sources.driver_tables import EVENT_GAP_MS, read_events, trips
from faregrid.streaming import landing, runs, state
from faregrid.streaming.profitability import stream_empty_taxis, stream_last_dropoffs, stream_median_profit

SLIDING = Sliding()
CACHE_SIZE = 500
LOCAL_RATE, DURATION = 600, 6
START_MS = 1_700_000_000_000


def _round(df: DataFrame, *names: str) -> DataFrame:
    # Means and ratios of amounts have few digits; at nine none is a tie.
    digits = 6 if "total_profit" in names else 9
    return df.withColumns({name: F.round(name, digits) for name in names})


def profitable_areas(spark, sf):
    return _round(P.profitable_areas(trips(spark, sf)), "profitability")


def profitable_areas_15min(spark, sf):
    return _round(P.profitable_areas(trips(spark, sf), window_ms=900_000), "profitability")


def profitable_areas_split(spark, sf):
    """The same with cells split into narrow bands of gains."""
    return _round(P.profitable_areas(trips(spark, sf), bands_per_octave=1024), "profitability")


def _distance(df: DataFrame) -> DataFrame:
    return _round(df, "avg_trip_distance")


def trip_distances(spark, sf):
    return _distance(trip_distance(trips(spark, sf)))


def profit_by_cell(spark, sf):
    return _round(median_profit(trips(spark, sf), SLIDING), "profit")


def profit_by_cell_uneven(spark, sf):
    """A window that is no multiple of its slide, so that panes are shorter than both."""
    return _round(median_profit(trips(spark, sf), Sliding(25_000, 10_000)), "profit")


def total_profit_by_cell(spark, sf):
    return _round(P.total_profit_by_cell(trips(spark, sf)), "total_profit")


def last_dropoffs(spark, sf):
    return last_dropoff_by_taxi(trips(spark, sf), SLIDING)


def empty_taxis(spark, sf):
    return empty_taxi_count(last_dropoffs(spark, sf), SLIDING.slide_ms)


def top_profitable_cells(spark, sf):
    # Ranked on the rounded value, so that both engines see the same ties.
    return P.top_profitable_cells(profitable_areas(spark, sf), 5)


def grid_cells(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    # Spread over and beyond the grid, so that points outside occur as well.
    points = read_events(spark, sf).select(
        "event_id",
        (F.lit(39.9) + ((F.col("event_id") * 7919) % 1000) * F.lit(0.0017)).alias("lat"),
        (F.lit(-75.1) + ((F.col("event_id") * 104729) % 1000) * F.lit(0.0017)).alias("lon"))
    return points.select(
        "event_id", grid.in_box(lat, lon).alias("in_box"), grid.in_grid(lat, lon).alias("in_grid"),
        grid.cell_we(lon).alias("we"), grid.cell_ns(lat).alias("ns"),
        grid.cell_text_id(lat, lon).alias("text_id"), grid.cell_flat_id(lat, lon).alias("flat_id"),
        F.round(grid.axis_km(F.lit(grid.O_LAT), lat), 6).alias("km_south"),
        F.round(grid.shifted(lat, 0.25) - grid.shifted(lat, -0.25), 9).alias("span"),
        F.round(grid.shifted(lon, 0.25) - grid.shifted(lon, -0.25), 9).alias("width"))


def cell_key_roundtrip(spark, sf):
    we, ns = F.col("pickup_we"), F.col("pickup_ns")
    key = F.col("cell_key")
    return trips(spark, sf).withColumn("cell_key", grid.pack_cell(we, ns)).select(
        "seq", "cell_key", grid.packed_we(key).alias("we"), grid.packed_ns(key).alias("ns"),
        grid.flat_id(we, ns).alias("flat_id"))


def ingest_trips17(spark, sf):
    return T.scan_trips17(spark, rendered.write_trips(spark, sf, vendor=False)).select(
        "medallion", "pickup_we", "pickup_ns", "dropoff_we", "dropoff_ns", "fare", "tip",
        F.unix_millis("dropoff_ts").alias("dropoff_ms"))


def ingest_trips18(spark, sf):
    return T.scan_trips18(spark, rendered.write_trips(spark, sf, vendor=True))


def _blocks17(spark, sf) -> DataFrame:
    path = rendered.write_trips(spark, sf, vendor=False)
    return blocks.cached_events(T.parse_trips17(blocks.read_blocks(spark, path, CACHE_SIZE)))


def block_scan(spark, sf):
    return _blocks17(spark, sf).select("block_id", "line_no", "medallion", "cache_idx", "cache_n")


def _plan(spark, sf) -> replay.Replay:
    instances = -(-read_events(spark, sf).count() // CACHE_SIZE)
    return replay.Replay(LOCAL_RATE * instances, DURATION, instances, START_MS)


def replay_events(spark, sf):
    return replay.replay_events(_blocks17(spark, sf), _plan(spark, sf)).select(
        "block_id", "emit_no", "arrival_ms", "line_no", "medallion", "seq")


def emitted_totals(spark, sf):
    return replay.emitted_totals(replay_events(spark, sf))


def _emitted(spark, sf) -> DataFrame:
    return replay.replay_events(_blocks17(spark, sf), _plan(spark, sf))


def throughput_samples(spark, sf):
    """Rates measured on the rows that were emitted."""
    return throughput.samples_from_checkpoints(replay.checkpoints(_emitted(spark, sf)), ["block_id"])


def checkpoint_samples(spark, sf):
    """Rates between recorded checkpoints: here, each user's events as one source."""
    checkpoints = read_events(spark, sf).select(
        "user_id", (F.col("event_id") * 1000).alias("t_ms"),
        (F.col("event_id") * F.col("event_id")).alias("total"))
    return _round(throughput.samples_from_checkpoints(checkpoints, ["user_id"]), "rate")


def checkpoint_samples_dense(spark, sf):
    """Checkpoints at uneven steps, mostly below a second, several at one time."""
    checkpoints = read_events(spark, sf).select(
        "user_id", (F.expr("event_id div 400") * 700 + F.expr("event_id % 3") * 150).alias("t_ms"),
        F.col("event_id").alias("total"))
    return _round(throughput.samples_from_checkpoints(checkpoints, ["user_id"]), "rate")


def steady_state_throughput(spark, sf):
    events = read_events(spark, sf)
    samples = events.select("user_id", F.col("event_id").alias("sample_no"), F.col("value").alias("rate"))
    return _round(throughput.steady_state(samples, ["user_id"], events), "steady_rate")


def steady_state_by_type(spark, sf):
    """Many sources with few samples or none."""
    events = read_events(spark, sf).withColumn("hour", F.expr("event_id div 100"))
    samples = events.where("event_type <> 'click'").select(
        "user_id", "hour", F.col("event_id").alias("sample_no"), F.col("value").alias("rate"))
    return _round(throughput.steady_state(samples, ["user_id", "hour"], events), "steady_rate")


def source_report(spark, sf):
    emitted = _emitted(spark, sf)
    samples = throughput.samples_from_checkpoints(replay.checkpoints(emitted), ["block_id"])
    totals = replay.emitted_totals(emitted)
    return reports.source_report(samples, throughput.steady_state(samples, ["block_id"], totals), totals, ["block_id"])


def run_event_log(spark, sf):
    return reports.run_event_log(_emitted(spark, sf), "throughput_results_q0")


def report_round_trip(spark, sf):
    """A report written into a run's folder and summed up again from its files."""
    events = read_events(spark, sf)
    samples = events.select("user_id", F.col("event_id").alias("sample_no"), F.col("value").alias("rate"))
    totals = events.groupBy("user_id").agg(F.count("*").alias("total_events"))
    report = reports.source_report(samples, throughput.steady_state(samples, ["user_id"]), totals, ["user_id"])
    main = scratch_dir(spark, "runs")
    reports.write_source_report(report, f"{main}/run1", ["user_id"])
    return throughput_summary(spark, main).select("run", F.round("total_throughput", 6).alias("total_throughput"))


def throughput_totals(spark, sf):
    totals = throughput_summary(spark, rendered.write_logs(spark, sf), "*.txt")
    return totals.select("run", F.round("total_throughput", 2).alias("total_throughput"))


def throughput_result_lines(spark, sf):
    return reports.summary_lines(throughput_totals(spark, sf))


def replicated(spark, sf):
    return _distance(replicated_distance(trips(spark, sf), 4))


def replayed_profitable_areas(spark, sf):
    """The whole job: text, blocks, cache, replay, windows, join."""
    plan = replace(_plan(spark, sf), duration_sec=20)
    emitted = replay.replay_events(_blocks17(spark, sf), plan)
    return _round(P.profitable_areas(emitted), "profitability")


def replayed_trip_distance(spark, sf):
    path = rendered.write_trips(spark, sf, vendor=True)
    cached = blocks.cached_events(T.parse_trips18(blocks.read_blocks(spark, path, CACHE_SIZE)))
    return _distance(trip_distance(replay.replay_events(cached, _plan(spark, sf))))


def stream_profitable_areas(spark, sf):
    return _round(runs.drain(spark, trips(spark, sf), S.FARE_TRIP, P.profitable_areas),
                  "profitability")


def stream_top_profitable_cells(spark, sf):
    return runs.drain(spark, trips(spark, sf), S.FARE_TRIP, P.profitable_areas, slices=1,
                      per_batch=lambda areas: P.top_profitable_cells(
                          _round(areas, "profitability"), 5))


def stream_trip_distance(spark, sf):
    return _distance(runs.drain(spark, trips(spark, sf), S.DISTANCE_TRIP, trip_distance))


def stream_profit_by_cell(spark, sf):
    def query(t):
        return stream_median_profit(t.withWatermark("ts", "0 seconds"), SLIDING).select(
            F.unix_millis("window.end").alias("window_end"), "cell_we", "cell_ns", "profit")
    return _round(runs.drain(spark, trips(spark, sf), S.FARE_TRIP, query), "profit")


def stream_total_profit(spark, sf):
    return _round(runs.drain(spark, trips(spark, sf), S.FARE_TRIP, P.total_profit_by_cell), "total_profit")


def _by_seq(lines: DataFrame) -> list[DataFrame]:
    """Lines in the order of `seq`, in two parts or more of bounded size."""
    last, n = lines.agg(F.max("seq"), F.count("*")).first()
    parts = max(2, -(-n // runs.slice_rows(lines.sparkSession)))
    ends = [last * (i + 1) // parts for i in range(parts)]
    return [lines.where((F.col("seq") <= end) & (F.col("seq") > start if start is not None else F.lit(True)))
            for start, end in zip((None, *ends), ends)]


def _text_stream(spark, sf, vendor: bool, query) -> DataFrame:
    """Lines with their arrival in front, as a text stream in several batches of bounded size, then the end."""
    base = scratch_dir(spark, "text-stream")
    out, checkpoint, arrived = f"{base}/out", f"{base}/checkpoint", f"{base}/in"
    parse = T.parse_trips18 if vendor else T.parse_trips17
    lines = rendered.trip_lines(read_events(spark, sf), vendor).select(
        "seq", F.concat_ws("\t", F.col("seq") * EVENT_GAP_MS, "seq", "value").alias("value"))

    def result() -> DataFrame:
        return query(runs.stamped_lines(spark, f"{arrived}/*", parse, **runs.SLICE_OPTIONS))

    def run() -> None:
        runs.run_available(result(), out, checkpoint, tasks_per_core=runs.SLICE_STATE_TASKS_PER_CORE)

    def write(part: DataFrame, path: str) -> None:
        part.select("value").repartition(runs.SLICE_FILES).write.option("maxRecordsPerFile", 0).text(path)

    runs.run_slices(_by_seq(lines), write, arrived, run, 2)
    write(rendered.last_line(spark, vendor), f"{arrived}/end")
    run()
    return spark.read.schema(result().schema).parquet(out)


def stream_text_trip_distance(spark, sf):
    return _distance(_text_stream(spark, sf, True, trip_distance))


def stream_text_profitable_areas(spark, sf):
    return _round(_text_stream(spark, sf, False, P.profitable_areas), "profitability")


def _late_arrivals(spark, sf, files: int) -> str:
    """Three quarters of the trips, then the first quarter again, then the rest, each in so many files;
    the folder they were landed in."""
    table = trips(spark, sf).select(*(F.col(f.name).cast(f.dataType) for f in S.DISTANCE_TRIP.fields))
    base = scratch_dir(spark, "late")
    last = table.agg(F.max(F.unix_millis("ts"))).first()[0]
    for part in ("ms <= 0.75 * last", "ms < 0.25 * last", "ms > 0.75 * last"):
        rows = table.withColumns({"ms": F.unix_millis("ts"), "last": F.lit(last)}).where(part).drop("ms", "last")
        rows.repartition(files).write.mode("append").parquet(f"{base}/in")
        landing.land_rows(runs.read_stream(spark, f"{base}/in", S.DISTANCE_TRIP), f"{base}/landed", 2000)
    return f"{base}/landed"


def stream_late_rows(spark, sf):
    """Late rows themselves, as they were before any aggregation; how often each arrived late."""
    late = [landing.late_rows(spark, _late_arrivals(spark, sf, files), S.DISTANCE_TRIP).withColumn("files", F.lit(files))
            for files in (1, 8)]
    return late[0].unionAll(late[1]).select(
        "files", "batch", "seq", F.unix_millis("ts").alias("ts_ms"), "pickup_cell", "trip_distance")


def stream_on_time_distance(spark, sf):
    """What is on time, streamed on from where it was landed: the late rows change nothing."""
    landed, base = _late_arrivals(spark, sf, 4), scratch_dir(spark, "on-time")
    landing.land_end(spark, landed, runs.sentinel(spark, S.DISTANCE_TRIP))
    result = trip_distance(landing.landed_stream(spark, landed, S.DISTANCE_TRIP))
    runs.run_available(result, f"{base}/out", f"{base}/checkpoint")
    return _distance(spark.read.schema(result.schema).parquet(f"{base}/out"))


def _landed_lines(spark, sf, then: Callable[[str], object] | None = None) -> str:
    """Plain lines, without arrival or number, in two micro-batches of several files, more if there are many lines.
    Drop-off times are whole seconds, so many trips of a second differ by their place alone. `then` is called on the
    folder whenever some have been landed."""
    base = scratch_dir(spark, "landed-lines")
    lines = rendered.trip_lines(read_events(spark, sf), False)

    def write(part: DataFrame, path: str) -> None:
        part.repartitionByRange(runs.SLICE_FILES, "seq").sortWithinPartitions("seq").select("value").write.option(
            "maxRecordsPerFile", 0).text(path)

    def land() -> None:
        landing.land_lines(spark, f"{base}/in/*", f"{base}/landed", T.parse_trips17, F.col("dropoff_ts"), 10_000, order=["file"],
                           **runs.SLICE_OPTIONS)
        if then is not None:
            then(f"{base}/landed")

    runs.run_slices(_by_seq(lines), write, f"{base}/in", land, 2)
    return f"{base}/landed"


def stream_text_last_dropoff(spark, sf):
    """The last drop-off by arrival, of trips that share a micro-batch and a second."""
    base, done = scratch_dir(spark, "text-last"), 0

    def result(landed: str, **options: str) -> DataFrame:
        return stream_last_dropoffs(landing.landed_stream(spark, landed, S.FARE_TRIP, **options), SLIDING)

    def run(landed: str) -> None:
        nonlocal done
        options, done = landing.batch_by_batch(spark, landed, done)
        runs.run_available(result(landed, **options), f"{base}/out", f"{base}/checkpoint", tasks_per_core=runs.SLICE_STATE_TASKS_PER_CORE)

    landed = _landed_lines(spark, sf, run)
    landing.land_end(spark, landed, runs.sentinel(spark, S.FARE_TRIP))
    run(landed)
    return spark.read.schema(result(landed).schema).parquet(f"{base}/out")


def landed_order(spark, sf):
    """Each landed line's rank by arrival."""
    rows = spark.read.schema(S.FARE_TRIP).parquet(f"{_landed_lines(spark, sf)}/rows")
    by_block = Window.partitionBy(F.unix_millis("ts")).orderBy("seq")
    return rows.select(F.unix_millis("ts").alias("ts_ms"), "medallion", "fare", F.row_number().over(by_block).cast("long").alias("place"))


def arrival_stamps(spark, sf):
    """Lines that arrive now: all are stamped, with times from while the stream ran."""
    base = scratch_dir(spark, "now")
    rendered.trip_lines(read_events(spark, sf), True).select("value").write.text(f"{base}/in")
    before = spark.sql("select unix_millis(current_timestamp())").first()[0]
    runs.run_available(runs.arriving_lines(spark, f"{base}/in", T.parse_trips18), f"{base}/out", f"{base}/checkpoint")
    after = spark.sql("select unix_millis(current_timestamp())").first()[0]
    at = F.unix_millis("ts")
    return spark.read.parquet(f"{base}/out").agg(
        F.count("*").alias("n"), F.count_if(at.between(before, after) & F.col("seq").isNotNull()).alias("n_stamped"))


def _two_streams(spark, sf) -> DataFrame:
    """Two named queries, each stopped and started again between micro-batches; their progress table."""
    base, log = scratch_dir(spark, "progress-run"), runs.ProgressLog(spark, every=2)
    table = trips(spark, sf)
    half = table.agg(F.max("seq")).first()[0] // 2
    for name, schema, query in (("distance", S.DISTANCE_TRIP, trip_distance), ("profit", S.FARE_TRIP, P.total_profit_by_cell)):
        rows = table.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
        for part in (rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half), runs.sentinel(spark, schema)):
            part.write.mode("append").parquet(f"{base}/{name}/in")
            log.wait_for(runs.run_available(
                query(runs.read_stream(spark, f"{base}/{name}/in", schema)), f"{base}/{name}/out", f"{base}/{name}/state", name=name))
    return log.close()


def stream_emitted_totals(spark, sf):
    """What streams really read: micro-batches that had rows, and rows, by query."""
    progress = _two_streams(spark, sf)
    batches = runs.progress_samples(progress).groupBy("query_id").agg(F.count("*").alias("batches"))
    return batches.join(runs.progress_totals(progress), "query_id")


def stream_source_report(spark, sf):
    """The report of real streams, but for the lines that hold a measured rate."""
    return reports.stream_report(_two_streams(spark, sf)).where("part <> 1 and line_no <> 1")


def stream_state_audit(spark, sf):
    """The rows that live in each operator's state after a drain without an end."""
    base = scratch_dir(spark, "audit")
    table = trips(spark, sf).select(*(F.col(f.name).cast(f.dataType) for f in S.FARE_TRIP.fields))

    def run() -> None:
        runs.run_available(P.profitable_areas(runs.read_slices(spark, f"{base}/in", S.FARE_TRIP)), f"{base}/out", f"{base}/checkpoint",
                           tasks_per_core=runs.SLICE_STATE_TASKS_PER_CORE)

    runs.run_slices(runs.time_slices(table, 1) or [table], runs.write_slice, f"{base}/in", run, 1)
    part = lambda name: F.get_json_object("key", f"$.{name}")
    return state.live_rows(spark, f"{base}/checkpoint").select(
        "operator_id", "operator", "window_end", part("cell_we").cast("int").alias("cell_we"), part("cell_ns").cast("int").alias("cell_ns"),
        part("medallion").alias("medallion"), F.round(part("gain").cast("double"), 9).alias("gain"))


def stream_profit_by_cell_hot(spark, sf):
    """All trips picked up in one cell, the median's state split by bands of gains."""
    def query(t):
        return stream_median_profit(t.withWatermark("ts", "0 seconds"), SLIDING, 16).select(
            F.unix_millis("window.end").alias("window_end"), "cell_we", "cell_ns", "profit")
    hot = trips(spark, sf).withColumns({"pickup_we": F.lit(300), "pickup_ns": F.lit(301)})
    return _round(runs.drain(spark, hot, S.FARE_TRIP, query), "profit")


def stream_profitable_areas_split(spark, sf):
    """The whole query with split medians."""
    return _round(runs.drain(spark, trips(spark, sf), S.FARE_TRIP, partial(P.profitable_areas, state_bands=4)), "profitability")


def stream_replicated_distance(spark, sf):
    """Four streams at the same time, each with a source, a state and a scheduler pool of its own."""
    base = scratch_dir(spark, "replicas")
    trips(spark, sf).select(*(F.col(f.name).cast(f.dataType) for f in S.DISTANCE_TRIP.fields)).write.parquet(f"{base}/in")
    runs.sentinel(spark, S.DISTANCE_TRIP).write.mode("append").parquet(f"{base}/in")
    return _distance(runs.run_replicas(
        lambda i: runs.read_stream(spark, f"{base}/in", S.DISTANCE_TRIP), trip_distance, 4, f"{base}/out", f"{base}/checkpoint"))


def checked_groups(spark, sf):
    """Counts that passed the test for one window per slot, by window label; pairs that passed that for equal labels."""
    counts = empty_taxis(spark, sf).groupBy("window_end").agg(F.count("*").alias("groups"))
    pairs = P.profitable_areas(trips(spark, sf)).groupBy("window_end").agg(F.count("*").alias("pairs"))
    return counts.join(pairs, "window_end", "left")


def discarded_rows(spark, sf):
    """Rows that reached the sink that keeps nothing."""
    seen = Observation()
    reports.discard(trip_distance(trips(spark, sf)).observe(seen, F.count("*").alias("n"), F.sum("count").alias("trips")))
    return spark.createDataFrame([(seen.get["n"], seen.get["trips"])], "n long, trips long")


def _some_blocks(spark, sf) -> range:
    return range(1, -(-read_events(spark, sf).count() // CACHE_SIZE), 6)


def block_scan_some(spark, sf):
    """A few blocks out of an indexed folder: only the files that hold them are opened."""
    path, index = rendered.write_trips(spark, sf, vendor=False), scratch_dir(spark, "index")
    blocks.index_lines(spark, path, index)
    lines = blocks.read_blocks(spark, path, CACHE_SIZE, blocks=_some_blocks(spark, sf), index=index)
    return blocks.cached_events(T.parse_trips17(lines)).select("block_id", "line_no", "medallion", "cache_idx", "cache_n")


def stream_empty_taxi_count(spark, sf):
    def query(t):
        return stream_empty_taxis(t, SLIDING).select(
            F.unix_millis("window.end").alias("window_end"), "cell_we", "cell_ns", "count")
    return runs.drain(spark, trips(spark, sf), S.FARE_TRIP, query)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "profitable_areas": profitable_areas,
    "profitable_areas_15min": profitable_areas_15min,
    "profitable_areas_split": profitable_areas_split,
    "trip_distance": trip_distances,
    "profit_by_cell": profit_by_cell,
    "profit_by_cell_uneven": profit_by_cell_uneven,
    "total_profit_by_cell": total_profit_by_cell,
    "last_dropoff_by_taxi": last_dropoffs,
    "empty_taxi_count": empty_taxis,
    "top_profitable_cells": top_profitable_cells,
    "grid_cells": grid_cells,
    "cell_key_roundtrip": cell_key_roundtrip,
    "ingest_trips17": ingest_trips17,
    "ingest_trips18": ingest_trips18,
    "block_scan": block_scan,
    "replay_events": replay_events,
    "emitted_totals": emitted_totals,
    "throughput_samples": throughput_samples,
    "checkpoint_samples": checkpoint_samples,
    "checkpoint_samples_dense": checkpoint_samples_dense,
    "steady_state_throughput": steady_state_throughput,
    "steady_state_by_type": steady_state_by_type,
    "report_round_trip": report_round_trip,
    "source_report": source_report,
    "run_event_log": run_event_log,
    "throughput_summary": throughput_totals,
    "throughput_result_lines": throughput_result_lines,
    "replicated_distance": replicated,
    "replayed_profitable_areas": replayed_profitable_areas,
    "replayed_trip_distance": replayed_trip_distance,
    "stream_profitable_areas": stream_profitable_areas,
    "stream_top_profitable_cells": stream_top_profitable_cells,
    "stream_trip_distance": stream_trip_distance,
    "stream_profit_by_cell": stream_profit_by_cell,
    "stream_empty_taxi_count": stream_empty_taxi_count,
    "stream_total_profit_by_cell": stream_total_profit,
    "stream_text_trip_distance": stream_text_trip_distance,
    "stream_text_profitable_areas": stream_text_profitable_areas,
    "stream_late_rows": stream_late_rows,
    "stream_on_time_distance": stream_on_time_distance,
    "stream_text_last_dropoff": stream_text_last_dropoff,
    "landed_order": landed_order,
    "arrival_stamps": arrival_stamps,
    "stream_emitted_totals": stream_emitted_totals,
    "stream_source_report": stream_source_report,
    "stream_state_audit": stream_state_audit,
    "stream_profit_by_cell_hot": stream_profit_by_cell_hot,
    "stream_profitable_areas_split": stream_profitable_areas_split,
    "stream_replicated_distance": stream_replicated_distance,
    "checked_groups": checked_groups,
    "discarded_rows": discarded_rows,
    "block_scan_some": block_scan_some,
}
