"""Text reports of sources and runs, and the sink that keeps nothing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from faregrid.functions.scalars import format_ms
from faregrid.operators import throughput
from faregrid.sources.logs import (
    RESULT_LINE, RULE, SAMPLES_HEAD, SAMPLES_TAIL, STEADY_LABEL, TOTAL_LABEL, default_scheme, open_folder)
from faregrid.streaming import runs


def discard(result: DataFrame) -> None:
    """Runs a batch query in full and throws the rows away."""
    result.write.format("noop").mode("overwrite").save()


def source_report(samples: DataFrame, steady: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Log lines of every source: numbered samples, steady-state mean, total.

    The last of `keys` is the instance number. Columns: keys, `part` (head, samples, trailer) and
    `line_no` (order within a part), `value`.
    """
    subtask = F.concat(F.lit("Subtask "), F.col(keys[-1]).cast("string"))

    def line(df: DataFrame, part: int, no, *texts) -> DataFrame:
        return df.select(*keys, F.lit(part).alias("part"), no.cast("long").alias("line_no"), F.concat(*texts).alias("value"))

    return (
        line(steady, 0, F.lit(0), F.lit(SAMPLES_HEAD), subtask, F.lit(SAMPLES_TAIL))
        .union(line(samples, 1, F.col("sample_no"), F.lit("Sample "), F.col("sample_no").cast("string"),
                    F.lit(": "), F.col("rate").cast("string")))
        .union(line(steady, 2, F.lit(0), F.lit(RULE)))
        .union(line(steady, 2, F.lit(1), subtask, F.lit(f" {STEADY_LABEL} "), F.col("steady_rate").cast("string")))
        .union(line(totals, 2, F.lit(2), subtask, F.lit(f" {TOTAL_LABEL} "), F.col("total_events").cast("string"))))


def stream_report(progress: DataFrame) -> DataFrame:
    """The report of streaming queries, each as one source, from their progress table: samples at steps
    of a second or more, their steady-state mean, and the rows read. Keys: `query_id`."""
    samples = throughput.samples_from_checkpoints(runs.progress_checkpoints(progress), ["query_id"])
    totals = runs.progress_totals(progress)
    return source_report(samples, throughput.steady_state(samples, ["query_id"], totals), totals, ["query_id"])


def write_source_report(report: DataFrame, run_dir: str, keys: list[str]) -> None:
    """Appends the lines to `.csv` files of `run_dir`, in order by source and line over its files.

    Ranges include the line number, so that one long report is spread over tasks. Lines hold
    neither quotes nor the separator, so they are written as they are.
    """
    order = [*keys, "part", "line_no"]
    (report.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
     .write.mode("append").option("sep", "\u0001").option("escapeQuotes", "false").csv(run_dir))


def run_event_log(emitted: DataFrame, name: str) -> DataFrame:
    """Start and end of every instance, from its first and last arrival."""
    spans = emitted.groupBy("block_id").agg(
        F.min("arrival_ms").alias("Started"), F.max("arrival_ms").alias("Ended"))
    return spans.unpivot("block_id", ["Started", "Ended"], "action", "at_ms").select(
        "block_id", "action", "at_ms",
        F.format_string("%s_subtask_%d Processing %s: %s (%d)", F.lit(name), "block_id", "action",
                        format_ms(F.col("at_ms")), "at_ms").alias("line"))


def append_event_log(log: DataFrame, path: str) -> None:
    log.select("line").write.mode("append").text(path)


def summary_lines(totals: DataFrame) -> DataFrame:
    """The one line each run's result file holds."""
    return totals.select("run", F.format_string(RESULT_LINE, "total_throughput").alias("value"))


def write_summary(totals: DataFrame, main_dir: str) -> None:
    """Writes `result.txt` into each run's own folder below `main_dir`; touches nothing else.

    One small file per run, written by the tasks that hold the runs. Spark's writers cannot name
    files, so this needs a local (shared) or HDFS folder; elsewhere use `write_summary_table`.
    """
    default = default_scheme(totals.sparkSession)
    if open_folder(main_dir, default)[0] is None:
        raise ValueError(f"{main_dir}: files can be named on local and HDFS folders only; use write_summary_table")

    def write(rows: Iterator[Row]) -> None:
        files, root = open_folder(main_dir, default)
        for row in rows:
            folder = f"{root.rstrip('/')}/{row['run']}"
            files.create_dir(folder)
            with files.open_output_stream(f"{folder}/result.txt") as out:
                out.write(f"{row['value']}\n".encode())

    summary_lines(totals).foreachPartition(write)


def write_summary_table(totals: DataFrame, path: str) -> None:
    """The same lines as text below `<path>/run=<run>`, on any file system that Spark writes."""
    summary_lines(totals).write.mode("overwrite").partitionBy("run").text(path)
