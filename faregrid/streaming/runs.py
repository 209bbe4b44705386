"""Feeding and running streaming queries."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from faregrid.functions.scalars import arrival_now
from faregrid.session import scratch_dir

SENTINEL_MEDALLION = "end-of-stream"

#: State partitions per core, at most: every micro-batch opens and commits all of them, filled or not.
STATE_TASKS_PER_CORE = 4
#: Trips of a time slice per core, about: they bound a micro-batch's state. Its partitions can then be few.
SLICE_ROWS_PER_CORE, SLICE_STATE_TASKS_PER_CORE = 80_000, 1
#: Files of a time slice, and slices that wait for one run: each of them is a micro-batch of its own.
SLICE_FILES, SLICES_PER_RUN = 8, 8
#: Slices that are cut by a scan each; more are written once, by their number.
SCANS = 4
#: What a query leaves on disk is bounded by these, unless the session sets them itself: old state goes once it is
#: behind the last batches, and files of a shuffle with the micro-batch that wrote them.
STATE_SETTINGS = {
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Groups of a slice's windows that a task may hold before it sorts the copied rows, about 1 KB each.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
}


def sentinel(spark: SparkSession, schema: StructType, ts: str = "2200-01-01 00:00:00") -> DataFrame:
    """One row far in the future, on no cell, that closes every window before it.

    Its own windows never close, so it does not reach the output.
    """
    given = {"ts": F.to_timestamp(F.lit(ts)), "seq": F.lit(2**62),
             "medallion": F.lit(SENTINEL_MEDALLION), "vendor_id": F.lit("VTS"),
             "fare": F.lit(0.0), "tip": F.lit(0.0), "trip_distance": F.lit(1e9)}
    # Column `pickup_cell` etc. must pass the > 0 tests for the row to move the watermark.
    return spark.range(1).select(*(
        given.get(f.name, F.lit(-1 if f.name.endswith(("_we", "_ns")) else 1))
        .cast(f.dataType).alias(f.name) for f in schema.fields))


def read_stream(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


@contextmanager
def state_settings(spark: SparkSession, tasks_per_core: int = STATE_TASKS_PER_CORE) -> Iterator[None]:
    """Queries that first start inside have at most so many state partitions per core, and STATE_SETTINGS.

    The session's number of shuffle partitions suits the whole data, a stream's state only holds open panes and
    windows. A query takes the number over when it starts and keeps it in its checkpoint.
    """
    name = "spark.sql.shuffle.partitions"
    most = tasks_per_core * spark.sparkContext.defaultParallelism
    changed = {name: str(min(int(spark.conf.get(name)), most))}
    changed |= {key: value for key, value in STATE_SETTINGS.items() if spark.conf.get(key, None) is None}
    before = {key: spark.conf.get(key, None) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def slice_rows(spark: SparkSession) -> int:
    return SLICE_ROWS_PER_CORE * spark.sparkContext.defaultParallelism


def time_slices(trips: DataFrame, slices: int, rows: int | None = None) -> list[DataFrame]:
    """The trips that have a time, in at least so many slices of equal length, of about `rows` trips at most."""
    ms, rows = F.unix_millis("ts"), rows or slice_rows(trips.sparkSession)
    low, high, n = trips.agg(F.min(ms), F.max(ms), F.count("ts")).first()
    if low is None:
        return []
    slices = max(slices, -(-n // rows))
    step, at = (high - low) // slices + 1, ms - low
    if slices <= SCANS:
        return [trips.where((at >= i * step) & (at < (i + 1) * step)) for i in range(slices)]
    spark, path = trips.sparkSession, scratch_dir(trips.sparkSession, "slices")
    trips.where("ts is not null").withColumn("slice", F.call_function("div", at, F.lit(step))).write.partitionBy("slice").parquet(path)
    numbered = spark.read.schema(StructType([*trips.schema.fields]).add("slice", "long")).parquet(path)
    return [numbered.where(F.col("slice") == i).drop("slice") for i in range(slices)]


#: Options of a stream that reads what `run_slices` puts down below a folder as `folder/*`: a slice per micro-batch,
#: and files go once the next one is begun.
SLICE_OPTIONS = {"maxFilesPerTrigger": str(SLICE_FILES), "cleanSource": "delete"}


def read_slices(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return read_stream(spark, f"{folder}/*", schema, **SLICE_OPTIONS)


def write_slice(part: DataFrame, path: str) -> None:
    part.repartition(SLICE_FILES).write.option("maxRecordsPerFile", 0).parquet(path)


def run_slices(slices: list[DataFrame], write: Callable[[DataFrame, str], None], folder: str, run: Callable[[], object], runs: int) -> None:
    """Writes slices below `folder`, one after the other, and calls `run` at least `runs` times on what waits there.

    `write` makes SLICE_FILES files of a slice, so that a stream with SLICE_OPTIONS reads each as a micro-batch of its
    own. Of a small one there may be fewer; it is then the last one of its run.
    """
    together, waiting = max(1, min(SLICES_PER_RUN, len(slices) // runs)), 0
    for i, part in enumerate(slices):
        path, waiting = f"{folder}/{i:06d}", waiting + 1
        write(part, path)
        files = len(part.sparkSession.read.format("binaryFile").load(path).inputFiles())
        if waiting == together or files < SLICE_FILES or i == len(slices) - 1:
            run()
            waiting = 0


def run_available(
    result: DataFrame, out: str, checkpoint: str,
    per_batch: Callable[[DataFrame], DataFrame] | None = None, name: str | None = None,
    tasks_per_core: int = STATE_TASKS_PER_CORE, **options: str,
) -> StreamingQuery:
    """Processes what has arrived, writes parquet in append mode, and stops.

    `per_batch` is applied to each micro-batch's finished rows, for steps a stream does not
    know, such as a ranking. A window's rows leave the join in one micro-batch. Each batch
    has a folder of its own, so that a repeated batch replaces itself.
    """
    writer = (result.writeStream.outputMode("append")
              .option("checkpointLocation", checkpoint).options(**options)
              .trigger(availableNow=True))
    if name is not None:
        writer = writer.queryName(name)
    with state_settings(result.sparkSession, tasks_per_core):
        if per_batch is None:
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(
                lambda batch, no: per_batch(batch).write.mode("overwrite")
                .parquet(f"{out}/batch={no}")).start()
    query.awaitTermination()
    return query


def discard_stream(result: DataFrame, checkpoint: str, name: str, **trigger) -> StreamingQuery:
    """Starts a query whose results are thrown away."""
    return (
        result.writeStream.format("noop").outputMode("append").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def start_replicas(
    trips: Callable[[int], DataFrame], query: Callable[[DataFrame], DataFrame], copies: int,
    checkpoint: str, start: Callable[[DataFrame, str, str], StreamingQuery] | None = None, **trigger,
) -> list[StreamingQuery]:
    """Starts `copies` identical queries side by side, each on a source of its own.

    Each has a scheduler pool of its own name, so that under `spark.scheduler.mode` FAIR no copy waits
    for another one's tasks. `start` takes (result, checkpoint, name); by default results are discarded.
    """
    start = start or (lambda result, state, name: discard_stream(result, state, name, **trigger))
    context, queries = SparkSession.active().sparkContext, []
    before = context.getLocalProperty("spark.scheduler.pool")
    try:
        for i in range(copies):
            # A query's thread takes over the pool of the one that starts it.
            context.setLocalProperty("spark.scheduler.pool", f"query_{i}")
            queries.append(start(query(trips(i)), f"{checkpoint}/q{i}", f"query_{i}"))
    finally:
        context.setLocalProperty("spark.scheduler.pool", before)
    return queries


def run_replicas(
    trips: Callable[[int], DataFrame], query: Callable[[DataFrame], DataFrame], copies: int, out: str, checkpoint: str,
) -> DataFrame:
    """Runs the copies at the same time on what has arrived; all that they emitted, by `query_id`."""
    def start(result: DataFrame, state: str, name: str) -> StreamingQuery:
        with state_settings(result.sparkSession):
            return (result.writeStream.outputMode("append").queryName(name).format("parquet")
                    .option("checkpointLocation", state).option("path", f"{out}/query_id={name.split('_')[1]}")
                    .trigger(availableNow=True).start())
    for running in start_replicas(trips, query, copies, checkpoint, start):
        running.awaitTermination()
    result = query(trips(0))
    parts = [result.sparkSession.read.schema(result.schema).parquet(f"{out}/query_id={i}").select(
        F.lit(i).alias("query_id"), "*") for i in range(copies)]
    return reduce(DataFrame.unionAll, parts)


def drain(
    spark: SparkSession, trips: DataFrame, schema: StructType,
    query: Callable[[DataFrame], DataFrame], slices: int = 2,
    per_batch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Streams bounded trips through `query` and returns everything it emitted.

    Trips arrive in time slices, a micro-batch each, more than `slices` if there are many trips. The query is stopped
    and restarted from its checkpoint at least `slices` times, so state is carried over restarts; the sentinel comes last.
    """
    base = scratch_dir(spark, "stream")
    arrived, out, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    trips = trips.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))

    def result() -> DataFrame:
        return query(read_slices(spark, arrived, schema))

    def run() -> None:
        run_available(result(), out, checkpoint, per_batch, tasks_per_core=SLICE_STATE_TASKS_PER_CORE)

    run_slices(time_slices(trips, slices), write_slice, arrived, run, slices)
    write_slice(sentinel(spark, schema), f"{arrived}/end")
    run()
    if per_batch is not None:
        return spark.read.parquet(out).drop("batch")
    return spark.read.schema(result().schema).parquet(out)


class ProgressLog(StreamingQueryListener):
    """Keeps one row of every micro-batch's progress and appends it to a table.

    Spark itself only remembers the latest progress of a query. Rows are written every `every` events
    and when the log is flushed, so the driver holds fewer than that. A micro-batch that is run
    again after a restart, or rows written twice, appear twice in the table; `progress_rows` reads each
    micro-batch once.
    """

    SCHEMA = ("query_id string, query string, run string, batch long, at_ms long, took_ms long, rows long, rate double, "
              "watermark string, late_groups long, state_rows long")

    def __init__(self, spark: SparkSession, path: str | None = None, every: int = 32):
        self.spark, self.path, self.every = spark, path or scratch_dir(spark, "progress"), every
        self.pending: list[tuple] = []
        self.ended: set[str] = set()
        self.lock = threading.Lock()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        started = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        with self.lock:
            self.pending.append((
                str(p.id), p.name or str(p.id), str(p.runId), p.batchId, int(started.timestamp() * 1000),
                int(p.batchDuration), p.numInputRows, float(p.processedRowsPerSecond), dict(p.eventTime).get("watermark"),
                sum(op.numRowsDroppedByWatermark for op in p.stateOperators), sum(op.numRowsTotal for op in p.stateOperators)))
            full = len(self.pending) >= self.every
        if full:
            self._write()

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait_for(self, *queries: StreamingQuery, seconds: float = 60) -> None:
        """Until the last event of every given (stopped) query has arrived."""
        until = time.monotonic() + seconds
        while not {str(q.runId) for q in queries} <= self.ended:
            if time.monotonic() > until:
                raise TimeoutError(f"progress of a stopped query did not arrive in {seconds} s: the log is incomplete")
            time.sleep(0.05)

    def _write(self) -> None:
        with self.lock:
            rows, self.pending = self.pending, []
        if rows:
            try:
                self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            except BaseException:
                with self.lock:  # written next time; rows that did arrive are read once
                    self.pending = rows + self.pending
                raise

    def flush(self) -> DataFrame:
        """Writes what is pending; returns the table."""
        self._write()
        return read_progress(self.spark, self.path)

    def close(self) -> DataFrame:
        self.spark.streams.removeListener(self)
        return self.flush()


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], ProgressLog.SCHEMA).write.mode("append").parquet(path)  # so that the folder is there
    return spark.read.schema(ProgressLog.SCHEMA).parquet(path)


def progress_rows(progress: DataFrame) -> DataFrame:
    """One row per query and micro-batch: of one that was run again, its last run's."""
    columns = [c for c in progress.columns if c not in ("query_id", "batch")]
    return progress.groupBy("query_id", "batch").agg(F.max_by(F.struct(*columns), F.struct("at_ms", "took_ms", "rows")).alias("p")).select(
        "query_id", "batch", "p.*")


def progress_samples(progress: DataFrame) -> DataFrame:
    """Rate of every micro-batch that read rows, by query, from a progress table."""
    return progress_rows(progress).where("rows > 0").select(
        F.col("query").alias("query_id"), F.col("batch").alias("sample_no"), "rate")


def progress_checkpoints(progress: DataFrame) -> DataFrame:
    """(query_id, t_ms, total): how many rows a query had read when each micro-batch was done, and 0 at its start."""
    rows = progress_rows(progress).select(
        F.col("query").alias("query_id"), "batch", "at_ms", (F.col("at_ms") + F.col("took_ms")).alias("t_ms"), "rows")
    upto = Window.partitionBy("query_id").orderBy("batch")  # one row per micro-batch
    done = rows.select("query_id", "t_ms", F.sum("rows").over(upto).alias("total"))
    return done.unionAll(rows.groupBy("query_id").agg(F.min("at_ms").alias("t_ms")).select("query_id", "t_ms", F.lit(0).cast("long")))


def progress_totals(progress: DataFrame) -> DataFrame:
    """Rows read by every query."""
    return progress_rows(progress).groupBy(F.col("query").alias("query_id")).agg(F.sum("rows").alias("total_events"))


def late_groups(progress: DataFrame) -> DataFrame:
    """What the watermark has dropped, by query, from a progress table.

    Spark counts as rows reach the state, behind the aggregation inside a task: groups, not rows.
    `faregrid.streaming.landing` has the rows.
    """
    return progress_rows(progress).groupBy(F.col("query").alias("query_id")).agg(F.sum("late_groups").alias("late_groups"))


def stamped_lines(
    spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], **options: str,
) -> DataFrame:
    """A text stream as trips, from lines with their arrival in front: `ms<TAB>seq<TAB>line`."""
    parts = F.split("value", "\t", 3)
    lines = spark.readStream.options(**options).text(path)
    return parse(lines.select(
        F.timestamp_millis(F.get(parts, F.lit(0)).try_cast("long")).alias("ts"),
        F.get(parts, F.lit(1)).try_cast("long").alias("seq"),
        F.get(parts, F.lit(2)).alias("value")).where("ts is not null and value is not null"))


def arriving_lines(
    spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame], **options: str,
) -> DataFrame:
    """A text stream as trips that arrive now: the lines of a micro-batch share its time. A text
    stream has no positions, so among them `seq` is a fixed order by hash; `landing.land_lines` keeps
    the order of arrival."""
    lines = spark.readStream.options(**options).text(path).withColumn(
        "place", F.pmod(F.xxhash64("value"), F.lit(1 << 20)))
    return parse(lines).withColumns({
        "ts": arrival_now(), "seq": F.unix_millis(arrival_now()) * (1 << 20) + F.col("place")}).drop("place")
