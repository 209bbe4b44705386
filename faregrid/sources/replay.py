"""Replaying a bounded set of trips at a fixed rate, on a modelled clock.

The clock is ideal: emitting takes no time. Events leave in bursts of 1000, one burst
every 1000 * (1e9 div rate) ns, and the duration is tested between bursts. Event k of an
instance is entry `k mod n` of its cache. Everything follows from arithmetic on k, so a
replay of any length is built in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the replay model.
BURST = 1000
NANOS = 1_000_000_000

# Repetitions of one cached event made by one row before the work is spread again.
REPEATS_PER_ROW = 4096


@dataclass(frozen=True)
class Replay:
    """`events_per_sec` is split over `instances` by integer division."""

    events_per_sec: int
    duration_sec: int
    instances: int = 1
    start_ms: int = 0
    spacing: str = "burst"  # or "even": event k at k * nanos_per_event

    @property
    def local_rate(self) -> int:
        return self.events_per_sec // self.instances

    @property
    def nanos_per_event(self) -> int:
        if self.local_rate <= 0:
            raise ValueError("an unlimited rate has no modelled clock; read the trips instead")
        return NANOS // self.local_rate

    @property
    def burst_nanos(self) -> int:
        nanos = BURST * self.nanos_per_event
        if nanos <= 0:
            raise ValueError("the rate is above one event per nanosecond")
        return nanos

    @property
    def bursts(self) -> int:
        """Bursts begun before the duration is over (rounded up)."""
        return -(-self.duration_sec * NANOS // self.burst_nanos)

    @property
    def total(self) -> int:
        """Events emitted by one instance."""
        return BURST * self.bursts


def replay_events(cached: DataFrame, replay: Replay) -> DataFrame:
    """Emits every instance's cache round-robin until its total is reached.

    Each cached row makes its own repetitions, so nothing is joined. Rows are re-spread
    between two bounded steps, which keeps tiny caches with long replays parallel.
    Adds `emit_no` (k), `arrival_ms`, `ts` and `seq` (arrival order over all instances).
    """
    k = F.col("emit_no")
    if replay.spacing == "even":
        offset_ms = F.expr(f"emit_no * {replay.nanos_per_event} div 1000000")
    else:
        offset_ms = F.expr(f"emit_no div {BURST} * {replay.burst_nanos} div 1000000")
    rounds = F.expr(f"({replay.total} - cache_idx + cache_n - 1) div cache_n")
    return (
        cached.where((F.col("cache_idx") < replay.total) & (F.col("block_id") < replay.instances))
        .withColumn("rounds", rounds)
        .withColumn("run_no", F.explode(F.sequence(
            F.lit(0).cast("long"), F.expr(f"(rounds - 1) div {REPEATS_PER_ROW}"))))
        .repartition("block_id", "cache_idx", "run_no")
        .withColumn("round", F.explode(F.sequence(
            F.col("run_no") * REPEATS_PER_ROW,
            F.least(F.col("rounds"), (F.col("run_no") + 1) * REPEATS_PER_ROW) - 1)))
        .withColumn("emit_no", F.col("cache_idx") + F.col("round") * F.col("cache_n"))
        .withColumn("arrival_ms", F.lit(replay.start_ms) + offset_ms)
        .withColumns({
            "ts": F.timestamp_millis("arrival_ms"),
            "seq": k * replay.instances + F.col("block_id")})
        .drop("rounds", "run_no", "round", "cache_idx", "cache_n"))


def emitted_totals(emitted: DataFrame) -> DataFrame:
    """Events emitted per instance."""
    return emitted.groupBy("block_id").agg(F.count("*").alias("total_events"))


def checkpoints(emitted: DataFrame) -> DataFrame:
    """What each instance had emitted when, as found in the rows: one checkpoint per burst."""
    return emitted.where(F.col("emit_no") % BURST == 0).select(
        "block_id", F.col("arrival_ms").alias("t_ms"), F.col("emit_no").alias("total"))


def replicate(trips: DataFrame, copies: int) -> DataFrame:
    """`copies` identical queries in one job: every row once per `query_id`."""
    if copies < 1:
        raise ValueError("at least one copy is needed")
    return trips.withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def live_replay(spark: SparkSession, cached: DataFrame, events_per_sec: int) -> DataFrame:
    """An unbounded stream of one instance's cache, `events_per_sec` rows a second.

    `cached` needs `cache_idx` 0..n-1. It is bounded by the cache size of the instance and
    read again in every micro-batch, so persist it or keep it as a table. Spark decides
    from its size whether to broadcast it.
    """
    n = cached.count()
    if n == 0:
        raise ValueError("the cache is empty; there is nothing to replay")
    ticks = (
        spark.readStream.format("rate").option("rowsPerSecond", events_per_sec).load()
        .withColumn("cache_idx", F.col("value") % n))
    return (
        ticks.join(cached.drop("ts", "seq"), "cache_idx")
        .withColumnRenamed("timestamp", "ts").withColumnRenamed("value", "seq"))
