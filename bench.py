"""Timings of the headline queries; prints one JSON line.

Two kinds of load: the tables as they are (`BENCH_SF_DIR`), and the same trips replayed at
100,000 events/s for `BENCH_REPLAY_SEC` seconds, the highest rate the workload is defined
for. Batch queries run once to warm up and are then timed. Streams read `BATCHES` files, one per
micro-batch, so that state is carried from batch to batch; `streams` has their rates and state.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from checks.queries import SLIDING  # noqa: E402
from faregrid import schema as S  # noqa: E402
from faregrid.operators.last_dropoff import empty_taxi_count, last_dropoff_by_taxi  # noqa: E402
from faregrid.operators.profit import median_profit  # noqa: E402
from faregrid.plans import profitability as P  # noqa: E402
from faregrid.plans.distance import trip_distance  # noqa: E402
from faregrid.session import build_session, scratch_dir  # noqa: E402
from faregrid.sinks.reports import discard  # noqa: E402
from faregrid.sources.blocks import cached_events  # noqa: E402
from faregrid.sources.driver_tables import trips  # noqa: E402
from faregrid.sources.replay import Replay, replay_events  # noqa: E402
from faregrid.streaming import runs  # noqa: E402

RATE = 100_000
CACHE_SIZE = 100_000
BATCHES = 20


def replayed(spark: SparkSession, sf_dir: str, seconds: int) -> tuple[DataFrame, int]:
    """All trips of the tables at the target rate, as a table in the scratch folder."""
    cached = cached_events(
        trips(spark, sf_dir).withColumnRenamed("seq", "line_no")
        .withColumn("block_id", F.expr(f"line_no div {CACHE_SIZE}")))
    instances = (cached.agg(F.max("block_id")).first()[0] or 0) + 1
    path = scratch_dir(spark, "replayed")
    emitted = replay_events(cached.drop("ts"), Replay(RATE, seconds, instances))
    emitted.drop("line_no", "block_id").write.parquet(path)
    table = spark.read.parquet(path)
    return table, table.count()


def timed(run, times: int = 2, warm: bool = True) -> float:
    if warm:
        run()
    best = float("inf")
    for _ in range(times):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def stream_seconds(spark: SparkSession, table: DataFrame, schema, query, name: str, found: dict) -> float:
    """One availableNow run over all rows, a slice of time per micro-batch, then the sentinel."""
    arrived = scratch_dir(spark, "bench-stream")
    rows = table.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
    at = F.unix_millis("ts")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    step = (high - low) // BATCHES + 1
    for k in range(BATCHES):  # one after the other: files are read in the order of their times
        rows.where((at >= low + k * step) & (at < low + (k + 1) * step)).coalesce(1).write.mode("append").parquet(arrived)
    runs.sentinel(spark, schema).coalesce(1).write.mode("append").parquet(arrived)
    log = runs.ProgressLog(spark)
    result = query(runs.read_stream(spark, arrived, schema, maxFilesPerTrigger="1"))
    start = time.perf_counter()
    running = runs.discard_stream(result, scratch_dir(spark, "bench-checkpoint"), name, availableNow=True)
    running.awaitTermination()
    seconds = round(time.perf_counter() - start, 3)
    log.wait_for(running)
    batches = runs.progress_rows(log.close()).where("rows > 0").agg(
        F.count("*"), F.median("rate"), F.max("state_rows"), F.median("took_ms")).first()
    found[name] = {"batches": batches[0], "median_rows_per_sec": round(batches[1]), "most_state_rows": batches[2],
                   "median_batch_sec": round(batches[3] / 1000, 3)}
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    seconds = int(os.environ.get("BENCH_REPLAY_SEC", "60"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    table = trips(spark, sf_dir)
    load, load_rows = replayed(spark, sf_dir, seconds)
    counts = lambda t: empty_taxi_count(last_dropoff_by_taxi(t, SLIDING), SLIDING.slide_ms)
    queries = {
        "profitable_areas": timed(lambda: discard(P.profitable_areas(table))),
        "trip_distance": timed(lambda: discard(trip_distance(table))),
        "profit_by_cell": timed(lambda: discard(median_profit(table, SLIDING))),
        "empty_taxi_count": timed(lambda: discard(counts(table))),
        "total_profit_by_cell": timed(lambda: discard(P.total_profit_by_cell(table))),
        "top_profitable_cells": timed(
            lambda: discard(P.top_profitable_cells(P.profitable_areas(table)))),
        "replayed_profitable_areas": timed(lambda: discard(P.profitable_areas(load)), times=1),
        "replayed_trip_distance": timed(lambda: discard(trip_distance(load)), times=1),
    }
    streams: dict = {}
    for prefix, source in (("", table), ("replayed_", load)):
        for name, schema, query in (("stream_trip_distance", S.DISTANCE_TRIP, trip_distance),
                                    ("stream_profitable_areas", S.FARE_TRIP, P.profitable_areas)):
            queries[prefix + name] = stream_seconds(spark, source, schema, query, prefix + name, streams)
    rows = {name: load_rows if name.startswith("replayed") else table.count() for name in queries}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "replayed_rows": load_rows, "streams": streams,
        "rows_per_sec": {name: round(rows[name] / sec) for name, sec in queries.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
