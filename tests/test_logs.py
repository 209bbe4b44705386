import re

from faregrid.operators import throughput
from faregrid.plans.summary import throughput_summary
from faregrid.schema import RUN_TOTAL
from faregrid.sinks import reports
from faregrid.sources import logs

LABEL = "Steady-State Average Throughput (events/sec):"


def test_summary(spark, tmp_path):
    files = {
        "20240102/q0_subtask_0.csv": f"--- x ---\nSample 1: 5.0\nSubtask 0 {LABEL} 9990.0\n",
        "20240102/q1_subtask_0.csv": f"Subtask 0 {LABEL} 10.25\nSubtask 1 {LABEL}   0.5\n",
        "20240102/deep/q2_subtask_0.csv": f"Subtask 0 {LABEL} 4.0\n",   # not read: one level only
        "20240102/config.txt": f"Subtask 0 {LABEL} 7.0\n",
        "20240101/q0_subtask_0.csv": f"Subtask 0 {LABEL} 1.2E7\nno {LABEL} number\n",
        "20240103/q0_subtask_0.csv": "Sample 1: 5.0\n",
        "20240104/config.txt": "nothing\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "stray.csv").write_text(f"Subtask 0 {LABEL} 3.0\n")
    totals = throughput_summary(spark, str(tmp_path))
    assert [(f.name, f.dataType) for f in totals.schema] == [
        (f.name, f.dataType) for f in RUN_TOTAL]
    assert [tuple(r) for r in totals.collect()] == [
        ("20240101", 12e6), ("20240102", 10000.75), ("20240103", 0.0), ("20240104", 0.0)]
    assert reports.summary_lines(totals).collect()[1].value == (
        "Total Processed Throughput: 10000.75 events/sec")
    before = {p: p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    reports.write_summary(totals, str(tmp_path))
    after = {p: p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert {p: t for p, t in after.items() if p in before} == before
    assert sorted(str(p.relative_to(tmp_path)) for p in after.keys() - before.keys()) == [
        f"2024010{k}/result.txt" for k in (1, 2, 3, 4)]
    assert after[tmp_path / "20240102/result.txt"] == "Total Processed Throughput: 10000.75 events/sec\n"
    assert throughput_summary(spark, f"file://{tmp_path}").collect() == totals.collect()


def test_odd_names_and_schemes(spark, tmp_path):
    """Names with blanks, plus and percent signs; the same folder with and without a scheme."""
    main = tmp_path / "a b+c"
    for run in ("run 1", "100%", "x+y", "main"):
        (main / run).mkdir(parents=True)
        (main / run / "q 0.csv").write_text(f"Subtask 0 {LABEL} 2.5\n")
    (main / "empty").mkdir()
    (main / "run 1" / "deep").mkdir()
    (main / "run 1" / "deep" / "q.csv").write_text(f"Subtask 0 {LABEL} 9.0\n")
    want = [("100%", 2.5), ("empty", 0.0), ("main", 2.5), ("run 1", 2.5), ("x+y", 2.5)]
    for path in (str(main), f"{main}/", f"file:{main}", f"file://{main}"):
        assert [tuple(r) for r in throughput_summary(spark, path).collect()] == want, path
    for pattern, uri in ((logs._anchored("s3a://bucket/x/logs/"), "s3a://bucket/x/logs/r1/f.csv"),
                         (logs._anchored("/x/logs"), "hdfs://host:8020/x/logs/r1/f.csv"), (logs._anchored("logs"), "dbfs:/home/logs/r1/f.csv")):
        assert re.search(pattern, uri).group(1) == "r1" and not re.search(pattern, uri.replace("/f.csv", "/d/f.csv"))
    reports.write_summary_table(throughput_summary(spark, str(main)), str(tmp_path / "table"))
    assert spark.read.text(str(tmp_path / "table")).count() == 5
    assert logs.open_folder("s3a://bucket/x")[0] is None and logs.open_folder("/x", "s3a://bucket")[0] is None


def test_runs_without_any_log(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r2").mkdir()
    assert [tuple(r) for r in throughput_summary(spark, str(tmp_path)).collect()] == [("r1", 0.0), ("r2", 0.0)]
    assert throughput_summary(spark, str(tmp_path / "r1")).count() == 0


def test_report_can_be_summarised(spark, tmp_path):
    rows = [(b, k, 1000.0 if b else 5.5 * k) for b in range(2) for k in range(1, 5)]
    samples = spark.createDataFrame(rows, "block_id long, sample_no long, rate double")
    totals = spark.createDataFrame([(0, 7), (1, 5000)], "block_id long, total_events long")
    steady = throughput.steady_state(samples, ["block_id"], totals)
    report = reports.source_report(samples, steady, totals, ["block_id"])
    lines = [r.value for r in report.where("block_id = 1").orderBy("part", "line_no").collect()]
    assert lines == [
        "--- Subtask 1 Throughput Samples (events/sec) ---",
        *(f"Sample {i}: 1000.0" for i in range(1, 5)),
        "-----------------------------------------------------",
        f"Subtask 1 {LABEL} 1000.0", "Subtask 1 Total Events Emitted: 5000"]
    reports.write_source_report(report, str(tmp_path / "run1"), ["block_id"])
    written = [line for p in sorted((tmp_path / "run1").glob("*.csv")) for line in p.read_text().splitlines()]
    assert written == [r.value for r in report.orderBy("block_id", "part", "line_no").collect()]
    assert [tuple(r) for r in throughput_summary(spark, str(tmp_path)).collect()] == [("run1", 1000.0 + 5.5 * 2.5)]


def test_event_log_is_appended(spark, tmp_path):
    emitted = spark.createDataFrame([(0, 5), (0, 9), (3, 7)], "block_id long, arrival_ms long")
    for _ in range(2):
        reports.append_event_log(reports.run_event_log(emitted, "q0"), str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert len(lines) == 8 and len(set(lines)) == 4
