"""What the text operators share: reading tables, written intermediates, Arrow batches."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faregrid.session import scratch_dir

#: Text is handed to numpy in pieces of about so many bytes; a longer document is one piece.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read back: cuts the lineage, so that a
    lost executor costs only the tasks it ran, and several uses share one computation."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` whose workers find this package where the driver has it (a cluster whose
    machines do not share that folder gets it by `--py-files`)."""
    environment = df.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
    return df.mapInArrow(step, schema)


def kept_columns(df: DataFrame, results: list[str]) -> list[str]:
    """The columns that an operator passes on: those that no result column replaces."""
    return [c for c in df.columns if c not in results]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until `df` has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def extended(df: DataFrame, kept: list[str], fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of the kept columns followed by result columns."""
    return T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts as UTF-8 (null: empty), in runs of about `limit` bytes."""
    out, size = [], 0
    for text in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()):
        raw = text.as_py() or b""
        if out and size + len(raw) > limit:
            yield out
            out, size = [], 0
        out.append(raw)
        size += len(raw)
    if out:
        yield out


@contextmanager
def uncollected() -> Iterator[None]:
    """Many short-lived tuples would start Python's collector again and again over large caches
    that hold no cycles: it rests meanwhile."""
    resting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if resting:
            gc.enable()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes so that any of their bits may be used."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
