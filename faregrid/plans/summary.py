"""Total throughput per run, from the sources' logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faregrid.operators.throughput import run_totals
from faregrid.sources.logs import list_runs, read_steady_rates


def throughput_summary(spark: SparkSession, main_dir: str, files: str = "*.csv") -> DataFrame:
    """Sum of steady-state rates per run folder of `main_dir`, in run order."""
    return run_totals(read_steady_rates(spark, main_dir, files),
                      list_runs(spark, main_dir)).orderBy("run")
