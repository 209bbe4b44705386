import random

import pytest
from pyspark.sql import functions as F

from faregrid.operators import throughput
from faregrid.plans.distance import replicated_distance, trip_distance
from faregrid.sinks import reports
from faregrid.sources import replay as R


def cache(spark, *sizes):
    rows = [(b, i, n, f"{b}-{i}") for b, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(
        rows, "block_id long, cache_idx long, cache_n long, medallion string")


@pytest.mark.parametrize("rate, seconds, burst_ns, bursts", [
    (1000, 5, 1_000_000_000, 5), (1000, 0, 1_000_000_000, 0), (300, 1, 3_333_333_000, 1),
    (300, 5, 3_333_333_000, 2), (999, 1, 1_001_001_000, 1), (7000, 1, 142_857_000, 8),
    (7000, 5, 142_857_000, 36), (12_345, 5, 81_004_000, 62)])
def test_closed_form(rate, seconds, burst_ns, bursts):
    plan = R.Replay(rate, seconds)
    assert (plan.burst_nanos, plan.bursts, plan.total) == (burst_ns, bursts, 1000 * bursts)


def test_events(spark, monkeypatch):
    monkeypatch.setattr(R, "REPEATS_PER_ROW", 7)   # several rows per cached event
    plan = R.Replay(2 * 900 + 1, 3, instances=2, start_ms=5)
    got = R.replay_events(cache(spark, 3, 1, 4), plan).collect()   # block 2 has no instance
    assert len(got) == 2 * 3000
    for r in got:
        assert r.medallion == f"{r.block_id}-{r.emit_no % (3, 1)[r.block_id]}"
        assert r.arrival_ms == 5 + (0, 1111, 2222)[r.emit_no // 1000]
        assert r.seq == r.emit_no * 2 + r.block_id
    assert {(r.block_id, r.emit_no) for r in got} == {(b, k) for b in (0, 1) for k in range(3000)}
    emitted = R.replay_events(cache(spark, 3, 1, 4), plan)
    assert {(r.block_id, r.total_events) for r in R.emitted_totals(emitted).collect()} == {(0, 3000), (1, 3000)}
    marks = [(b, 5 + ms, n) for b in (0, 1) for ms, n in ((0, 0), (1111, 1000), (2222, 2000))]
    assert sorted(map(tuple, R.checkpoints(emitted).collect())) == marks
    samples = throughput.samples_from_checkpoints(R.checkpoints(emitted), ["block_id"]).collect()
    assert sorted((r.block_id, r.sample_no, round(r.rate, 3)) for r in samples) == [
        (b, k, 900.09) for b in (0, 1) for k in (1, 2)]


def test_even_spacing(spark):
    plan = R.Replay(1000, 1, spacing="even")
    got = R.replay_events(cache(spark, 10), plan).collect()
    assert sorted(r.arrival_ms for r in got) == list(range(1000))


def test_cache_larger_than_the_replay(spark):
    assert R.replay_events(cache(spark, 1500), R.Replay(1000, 1)).count() == 1000


def test_limits(spark):
    assert R.Replay(100_000, 10, instances=3).local_rate == 33_333
    with pytest.raises(ValueError):
        R.Replay(2, 10, instances=3).total


def test_steady_state(spark):
    rows = [(q, i, float(v)) for q, vs in {
        "a": [5, 10, 20, 99], "b": [10, 20, 99], "c": [10, 20], "d": [7]}.items()
        for i, v in enumerate(vs, 1)]
    samples = spark.createDataFrame(rows, "q string, sample_no long, rate double")
    sources = spark.createDataFrame([(x,) for x in "abcde"], "q string")
    got = {r.q: r.steady_rate for r in throughput.steady_state(samples, ["q"], sources).collect()}
    assert got == {"a": 15.0, "b": 20.0, "c": 15.0, "d": 7.0, "e": 0.0}


def test_middle_samples_only_are_added_up(spark):
    rows = [("a", i, v) for i, v in enumerate([1e17, 1.0, 2.0, 3.0, 5.0])]
    samples = spark.createDataFrame(rows, "q string, sample_no long, rate double")
    assert [r.steady_rate for r in throughput.steady_state(samples, ["q"]).collect()] == [2.0]


def samples_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "q string, t_ms long, total long")
    got = throughput.samples_from_checkpoints(df, ["q"], **options).collect()
    return sorted((r.q, r.sample_no, r.rate) for r in got)


def test_checkpoint_samples(spark):
    rows = [("a", 0, 0), ("a", 1000, 500), ("a", 3000, 2500), ("b", 10, 0)]
    assert samples_of(spark, rows) == [("a", 1, 500.0), ("a", 2, 1000.0)]
    # Steps below a second are passed over; at the same time the largest total counts.
    dense = [("a", 10 * k, k) for k in range(301)]
    assert samples_of(spark, dense) == [("a", k, 100.0) for k in (1, 2, 3)]
    ties = [("a", 0, 0), ("a", 1000, 10), ("a", 1000, 20), ("a", 2000, 30), ("a", 2500, 33)]
    assert samples_of(spark, ties) == [("a", 1, 20.0), ("a", 2, 10.0)]
    assert samples_of(spark, ties, min_interval_ms=500) == [("a", 1, 20.0), ("a", 2, 10.0), ("a", 3, 6.0)]
    assert samples_of(spark, [("a", 5, 1)]) == []


def test_run_event_log(spark):
    emitted = R.replay_events(cache(spark, 3), R.Replay(1000, 2, start_ms=1_700_000_000_000))
    lines = {r.line for r in reports.run_event_log(emitted, "run_q0").collect()}
    assert lines == {
        "run_q0_subtask_0 Processing Started: 2023-11-14 22:13:20.000 (1700000000000)",
        "run_q0_subtask_0 Processing Ended: 2023-11-14 22:13:21.000 (1700000001000)"}


def test_replicas_match_single(spark):
    df = spark.range(200).select(
        F.timestamp_millis(F.col("id") * 50).alias("ts"), F.lit("VTS").alias("vendor_id"),
        F.lit(600).alias("pickup_cell"), F.lit(600).alias("dropoff_cell"),
        (F.col("id") / 10).alias("trip_distance"))
    single = {tuple(r) for r in trip_distance(df).collect()}
    copies = replicated_distance(df, 3).collect()
    assert {r.query_id for r in copies} == {0, 1, 2}
    for q in range(3):
        assert {tuple(r)[1:] for r in copies if r.query_id == q} == single


def plain_samples(rows, step):
    """One source after the other, one checkpoint after the other."""
    totals = {}
    for q, t, total in rows:
        if t is not None:
            own = totals.setdefault(q, {})
            own[t] = max(own.get(t, total), total)
    out = []
    for q, own in totals.items():
        last = number = None
        for t in sorted(own):
            if last is None:
                last, number = t, 0
            elif t - last >= step:
                number += 1
                out.append((q, number, (own[t] - own[last]) / (t - last) * 1000.0))
                last = t
    return sorted(out, key=str)


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_samples_match_plain_python(spark, step):
    """Dense runs, long gaps, times before 0, several groups and levels, sources without a name."""
    rng = random.Random(step)
    rows = []
    for source, n, reach in (("a", 400, 3), ("b", 300, 2.5 * step), ("c", 60, 900 * step), ("d", 1, 1), (None, 50, 70 * step)):
        t = rng.randrange(-100 * step, 100)
        for k in range(n):
            t += rng.randrange(0, int(reach) + 1) if rng.random() < 0.98 else 5000 * step
            rows += [(source, t, k)] * rng.randrange(1, 3)
    rows += [("a", None, 5), ("e", None, 1)]
    df = spark.createDataFrame(rows, "q string, t_ms long, total long").repartition(3)
    got = throughput.samples_from_checkpoints(df, ["q"], min_interval_ms=step)
    assert sorted(map(tuple, got.collect()), key=str) == plain_samples(rows, step)


def test_only_close_checkpoints_are_walked(spark, monkeypatch):
    """Far checkpoints make no links; of a few close ones among them, only those do, on one level."""
    linked, walked = throughput._linked, []
    monkeypatch.setattr(throughput, "_linked", lambda nodes, span: walked.append(nodes.count()) or linked(nodes, span))
    rows = [("ab"[k % 2], 100_000 * k, k) for k in range(300)]
    assert samples_of(spark, rows) == sorted(plain_samples(rows, 1000)) and walked == []
    rows += [("a", 7_000_000 + 400 * k, k) for k in range(6)]
    assert samples_of(spark, rows) == sorted(plain_samples(rows, 1000)) and walked == [6]


def test_one_source_is_spread_over_tasks(spark):
    """No Python, and every step's groups are bounded by time, not by source."""
    df = spark.range(40_000).select(F.lit("a").alias("q"), (F.col("id") * 300).alias("t_ms"), F.col("id").alias("total"))
    got = throughput.samples_from_checkpoints(df, ["q"])
    assert got.agg(F.count("*"), F.max("sample_no")).first() == (9999, 9999)
    assert got.agg(F.min("rate"), F.max("rate")).first() == (pytest.approx(4 / 1.2), pytest.approx(4 / 1.2))
    assert "Arrow" not in got._jdf.queryExecution().toString() and "Python" not in got._jdf.queryExecution().toString()
    points = df.select(F.struct("q").alias("source"), F.col("t_ms").alias("t"))
    groups = throughput._linked(throughput._successors(points, 1000), 1000 * throughput.FANOUT)
    assert groups.agg(F.max(F.size("nodes"))).first()[0] <= 64_000 // 300 + 1
    assert groups.count() == -(-40_000 * 300 // 64_000)


def test_no_checkpoints(spark):
    none = spark.createDataFrame([], "q string, t_ms long, total long")
    got = throughput.samples_from_checkpoints(none, ["q"])
    assert got.columns == ["q", "sample_no", "rate"] and got.count() == 0
