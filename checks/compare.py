"""Runs registered queries against their SQL and reports differences.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES


def _canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(row[i] for i in order) for row in rows]
    out.sort(key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float))
                                 else (False, "n", v) for v in r))
    return [columns[i] for i in order], out


def _same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    return a == b


def oracle_rows(sf_dir: str, sql: str):
    with duckdb.connect() as db:
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            name = os.path.splitext(os.path.basename(path))[0]
            db.execute(f"create view {name} as select * from '{path}'")
        result = db.execute(sql)
        return _canonical([d[0] for d in result.description], result.fetchall())


def difference(df: DataFrame, sf_dir: str, sql: str) -> str | None:
    """None if both sides hold the same rows, else what differs."""
    columns, rows = _canonical(df.columns, df.collect())
    want_columns, want = oracle_rows(sf_dir, sql)
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    bad = [(r, w) for r, w in zip(rows, want) if not all(map(_same, r, w))]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None


def main(argv: list[str]) -> int:
    from faregrid.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark: SparkSession = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = difference(df, sf_dir, ORACLES[name])
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:7.2f}s  {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
