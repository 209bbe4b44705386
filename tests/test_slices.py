"""Streams over many trips: micro-batches of bounded size, what they leave on disk, fields that are read once."""

import contextlib
import io
import os

import duckdb
import pytest

from checks.compare import difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from faregrid import schema as S
from faregrid.plans.distance import trip_distance
from faregrid.sources.trips import parse_trips17, parse_trips18
from faregrid.streaming import landing, runs

N, ROWS = 2400, 600


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """A table of 2,400 events, 50 ms apart: taxis come again, gains are equal now and then."""
    path = tmp_path_factory.mktemp("events")
    duckdb.sql(f"""copy (select i as event_id, timestamp '2020-01-01' + to_seconds(i) as ts, i * 7 % 41 as user_id,
        ['click', 'view', 'signup'][i % 3 + 1] as event_type, (i * 37 % 90) / 4 as value, '' as props
        from range({N}) t(i)) to '{path}/events.parquet' (format parquet)""")
    return str(path)


@pytest.fixture
def small_slices(spark, monkeypatch):
    monkeypatch.setattr(runs, "SLICE_ROWS_PER_CORE", ROWS // spark.sparkContext.defaultParallelism, raising=False)
    monkeypatch.setattr(runs, "SCANS", 2, raising=False)


@pytest.mark.parametrize("name", [
    "stream_text_profitable_areas", "stream_profitable_areas", "stream_state_audit", "stream_text_last_dropoff", "stream_top_profitable_cells"])
def test_micro_batches_are_bounded(spark, events, small_slices, name):
    log = runs.ProgressLog(spark)
    try:
        problem = difference(QUERIES[name](spark, events), events, ORACLES[name])
    finally:
        progress = runs.progress_rows(log.close()).collect()
    assert problem is None
    assert max(p.rows for p in progress) <= 2 * ROWS + 50  # two branches read each trip
    assert len([p for p in progress if p.rows >= ROWS // 2]) >= N // ROWS


def test_slices_leave_little_behind(spark, events, small_slices, tmp_path, monkeypatch):
    """Files of trips go when they have been read, and so does state that is behind the last batches."""
    from faregrid.sources.driver_tables import trips
    monkeypatch.setattr(runs, "scratch_dir", lambda _, name: str(tmp_path / name))
    table = trips(spark, events)
    got = runs.drain(spark, table, S.DISTANCE_TRIP, trip_distance, slices=1)
    assert got.count() == trip_distance(table).count()
    left = [name for name in (tmp_path / "stream" / "in").rglob("part-*.parquet") if name.parent.name != "end"]
    assert len(left) <= runs.SLICE_FILES
    assert len([n for n in os.listdir(tmp_path / "stream" / "checkpoint" / "offsets") if n.isdigit()]) <= 4


def test_settings_of_the_session_stay(spark):
    kept = "spark.sql.streaming.minBatchesToRetain"
    spark.conf.set(kept, "7")
    try:
        with runs.state_settings(spark):
            assert spark.conf.get(kept) == "7"
            assert spark.conf.get("spark.sql.streaming.stateStore.minDeltasForSnapshot") == "2"
        assert spark.conf.get(kept) == "7"
        assert spark.conf.get("spark.sql.streaming.stateStore.minDeltasForSnapshot", None) is None
    finally:
        spark.conf.unset(kept)


def test_a_small_slice_ends_its_run(spark, tmp_path):
    """A slice with fewer files would share a micro-batch with a part of the next one."""
    ran = []
    parts = [spark.range(n) for n in (100, 2, 100, 100, 100)]
    folder = str(tmp_path / "in")
    runs.run_slices(parts, runs.write_slice, folder, lambda: ran.append(len(os.listdir(folder))), 1)
    assert ran == [2, 5]


def test_landed_batches_are_read_apart(spark, tmp_path):
    """As long as all in front of the last have as many files."""
    folder, files = str(tmp_path / "landed"), []
    for n in (100, 100, 2, 100):
        spark.range(n).selectExpr("id as seq", "timestamp_millis(id) as ts").write.mode("append").parquet(str(tmp_path / "in"))
        landing.land_rows(runs.read_stream(spark, str(tmp_path / "in"), "seq long, ts timestamp"), folder, 10**9)
        files.append(landing.batch_by_batch(spark, folder))
    limit = {"maxFilesPerTrigger": str(runs.SLICE_FILES)}
    assert files == [(limit, 1), (limit, 2), (limit, 3), ({}, 4)]
    assert landing.batch_by_batch(spark, folder, 3) == (limit, 4)


def test_a_line_is_split_once(spark, tmp_path):
    """Filters on a trip's fields are not moved in front of the step that reads them, once for every test."""
    (tmp_path / "lines").write_text("a,b\n")
    for parse in (parse_trips17, parse_trips18):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            parse(spark.read.text(str(tmp_path / "lines"))).explain()
        plan = text.getvalue()
        assert plan.count("regexp_replace(") == 1 and plan.count(" as double)") == len([
            f for f in ("lat", "lon") * 2 + (("fare", "tip") if parse is parse_trips17 else ("distance",))])
