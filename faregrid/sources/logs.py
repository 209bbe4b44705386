"""Throughput logs: `<main>/<run>/*.csv`, plain text with one steady-state line per source."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the log format.
SAMPLES_HEAD, SAMPLES_TAIL = "--- ", " Throughput Samples (events/sec) ---"
RULE = "-" * 53
TOTAL_LABEL = "Total Events Emitted:"
RESULT_LINE = "Total Processed Throughput: %.2f events/sec"
STEADY_LABEL = "Steady-State Average Throughput (events/sec):"
# The exponent matters: large rates are printed like 1.2E7.
STEADY_PATTERN = r"Steady-State Average Throughput \(events/sec\):\s*([0-9.]+(?:E-?[0-9]+)?)"


def _anchored(main_dir: str) -> str:
    """A pattern of `<main>/<run>/<file>` with the run as its group, for paths with or without scheme.

    A path without scheme is on the session's default file system, as everywhere in Spark.
    """
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", main_dir).rstrip("/")
    start = "^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/*" if root.startswith("/") else "(?:^|/)"
    return f"{start}{re.escape(root.lstrip('/'))}/([^/]+)/[^/]+$"


def _decoded(uri: Column) -> Column:
    """A file's path from its URI; a plus sign is itself."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def list_runs(spark: SparkSession, main_dir: str) -> DataFrame:
    """`run` of every folder directly below `main_dir` that holds a file of any name, and of empty ones
    where folders can be empty.

    Spark lists the files, on its executors once there are many folders, on any file system it reads.
    Object stores have no empty folders; a local or HDFS one is asked for them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(main_dir).select(
        F.regexp_extract("path", _anchored(main_dir), 1).alias("run")).where("run <> ''").distinct()
    empty = spark.createDataFrame([(name,) for name in empty_folders(spark, main_dir)], "run string")
    return files.unionAll(empty).distinct()


def empty_folders(spark: SparkSession, main_dir: str) -> list[str]:
    """Names of the folders below `main_dir` that hold nothing, on a local or HDFS file system."""
    files, root = open_folder(main_dir, default_scheme(spark))
    if files is None:
        return []
    found = files.get_file_info(fs.FileSelector(root.rstrip("/"), allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", "."))
                  and not files.get_file_info(fs.FileSelector(f.path)))


def default_scheme(spark: SparkSession) -> str:
    """The file system of paths without scheme."""
    return spark.sparkContext.getConf().get("spark.hadoop.fs.defaultFS", "file:///")


def open_folder(path: str, default: str = "file:///") -> tuple[fs.FileSystem | None, str]:
    """The file system of a path or URI, and the path on it; None for one that only Spark reads."""
    if not re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        path = default.rstrip("/") + path if not default.startswith("file:") else f"file:{path}"
    scheme, host, root = re.match("([^:]+):(//[^/]*)?(.*)", path, re.DOTALL).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), root
    return (fs.FileSystem.from_uri(f"hdfs:{host or '//default'}/")[0], root) if scheme == "hdfs" else (None, path)


def steady_rates(lines: DataFrame) -> DataFrame:
    """Steady-state rates from log lines (`value`, plus any key columns).

    Text that has no readable number after the label is skipped.
    """
    rate = F.regexp_extract("value", STEADY_PATTERN, 1).try_cast("double")
    return (
        lines.where(F.col("value").contains(STEADY_LABEL))
        .withColumn("steady_rate", rate).where("steady_rate is not null").drop("value"))


def read_steady_rates(spark: SparkSession, main_dir: str, files: str = "*.csv") -> DataFrame:
    """`run`, `file` and rate for every matching line of every run's own files; deeper ones are not read."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(main_dir)
    path = _decoded(F.col("_metadata.file_path"))
    found = lines.select("value", F.regexp_extract(path, _anchored(main_dir), 1).alias("run"),
                         _decoded(F.col("_metadata.file_name")).alias("file"))
    return steady_rates(found.where("run <> ''"))
