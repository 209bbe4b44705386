"""Embedding near-duplicates: rotated binary codes with correction factors.

Vectors of one label are turned by random rotations. The signs after a rotation are a binary
code; sixteen-bit pieces of the codes file each vector in `tables` buckets, where close vectors
are likely to meet. Two passes follow over buckets with several vectors:

1. By codes alone. With the code's correction factor (its inner product with the vector itself) and
   the partner's small-integer form, an unbiased estimate of the inner product of each pair is
   formed; its confidence bound at the wanted cosine rules out most pairs. Only vectors that
   have a pair left are looked at again.
2. These vectors' own components are brought to their buckets and cosines are recomputed in double
   precision. A pair that meets in several buckets counts in the first of its tables only.

Equal vectors are one class from the start. Buckets are cut into tiles of at most `tile` vectors
and compared tile by tile, so no bucket has to fit into a task, and what is written is one
count and one link per vector and tile, never the pairs.

The chance that a pair at the wanted cosine meets in some bucket is 1 - (1 - p**bits)**tables with
p = 1 - angle / pi: 0.965 at cosine 0.93, over 0.999 from 0.97 on. The confidence bound loses
another 0.0003.

Cases: a vector that is null, empty or zero, without id or label, or with a null or non-finite
component links with nothing; so do vectors of different lengths; a row without id has a null
component and is not kept; repeated rows are separate vectors; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.llm import common
from faregrid.llm.components import components

#: Buckets of at most so many vectors are compared many at a time, pair by pair.
SMALL = 32
#: Numbers of each side that are gathered at once for that.
GATHERED = 1 << 22


@dataclass(frozen=True)
class Near:
    cosine: float = 0.93
    bits: int = 16
    tables: int = 24
    #: Standard deviations of the estimate's error that a pair may be off.
    sure: float = 3.5
    tile: int = 1024
    seed: int = 11


def _rotations(size: int, near: Near) -> np.ndarray:
    """Random rotations whose rows, one below the other, give all tables' bits."""
    rng = np.random.default_rng(near.seed)
    n = -(-near.bits * near.tables // size)
    return np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(n)])


def _usable() -> Column:
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """(label, embedding, id, n): equal vectors of one label, named by their smallest id."""
    return rows.where(_usable()).groupBy("label", "embedding").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n"))


def coded(items: DataFrame, near: Near) -> DataFrame:
    """The classes with unit vectors, the keys of all tables, the first rotation's code, its factor
    and the integer form. Labels carry the vectors' length: only equal lengths are compared."""
    schema = ("id long, label string, n long, vector array<double>, keys array<int>, "
              "code binary, factor double, small binary, scale double")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == size))
                unit = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                turned = unit @ _rotations(size, near).T
                signs = turned[:, :near.bits * near.tables] > 0
                weights = 1 << np.arange(near.bits)
                keys = signs.reshape(len(unit), near.tables, near.bits) @ weights
                first = turned[:, :size]
                scale = np.abs(first).max(axis=1) / 126
                # Rounded up or down by a fixed random amount, so that the mean error is zero.
                dither = np.random.default_rng(near.seed).random(size)
                small = np.floor(first / scale[:, None] + dither).astype(np.int8)
                code = np.packbits(first > 0, axis=1)
                yield pa.RecordBatch.from_arrays([
                    own.column(0), own.column(1), own.column(3),
                    _lists(unit, pa.float64()), _lists(keys, pa.int32()),
                    pa.array([c.tobytes() for c in code], pa.binary()),
                    pa.array(np.abs(first).sum(axis=1) / np.sqrt(size)),
                    pa.array([s.tobytes() for s in small], pa.binary()), pa.array(scale)],
                    names=["id", "label", "n", "vector", "keys", "code", "factor", "small", "scale"])

    return common.map_arrow(items.select(
        "id", F.concat_ws("/", F.size("embedding"), "label").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"), "n"), step, schema)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def by_tiles(rows: DataFrame, payload: list[str], near: Near, schema: str,
             compare: Callable[[int, list, np.ndarray, np.ndarray], pa.RecordBatch | None],
             compare_pairs: Callable[[np.ndarray, list, np.ndarray, np.ndarray], pa.RecordBatch | None]) -> DataFrame:
    """Brings the rows of each (label, table, key, size) together, tile by tile with each other.

    `compare(table, columns, first, second)` gets two tiles of one bucket as row numbers, or the
    same tile twice, and returns its result rows. The pairs of small buckets of one label are compared in one
    go: `compare_pairs(tables, columns, first, second)` gets each row's table and the pairs' row numbers.
    """
    place = ["label", "table", "key"]
    rows = common.stored(rows, "filed")
    sizes = common.stored(rows.groupBy(*place).agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    tiles = F.ceil(F.col("members") / near.tile).cast("int")
    # A row goes to its tile's pairing with each tile of the bucket, its own included.
    paired = rows.join(sizes, place).withColumn("tile", F.pmod(F.xxhash64("id", "table"), tiles).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    group = [*place, "low", "high"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = paired.select(*place, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
                            "tile", *payload).repartition(n, *group).sortWithinPartitions(*group)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            bounds = _bounds(table)
            yield from _each(table, bounds[:-1])
            last = table.slice(int(bounds[-2])) if len(bounds) > 1 else table
            rest = last.combine_chunks().to_batches()[0] if len(last) else None
        if rest is not None:
            table = pa.Table.from_batches([rest])
            yield from _each(table, np.array([0, len(table)]))

    def _bounds(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(len(table) - 1, 0), bool)
        for k in range(len(group)):
            column = table.column(k).combine_chunks().dictionary_encode()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            change |= np.diff(column.indices.to_numpy(zero_copy_only=False)) != 0
        return np.concatenate(([0], np.flatnonzero(change) + 1, [len(table)]))

    def _each(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        few = (sizes > 1) & (sizes <= SMALL)
        yield from _together(table, bounds[:-1][few], sizes[few])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > SMALL:
                own = table.slice(a, b - a)
                at, low, high, tile = (own.column(k).to_numpy() for k in (1, 3, 4, 5))
                first, second = np.flatnonzero(tile == low[0]), np.flatnonzero(tile == high[0])
                if len(first) and len(second):
                    out = compare(int(at[0]), own.columns[6:], first, second)
                    if out is not None:
                        yield out

    def _together(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(starts):
            return
        labels = table.column(0).take(pa.array(starts)).combine_chunks().dictionary_encode()
        labels = labels.chunk(0) if isinstance(labels, pa.ChunkedArray) else labels
        label = labels.indices.to_numpy(zero_copy_only=False)
        for own in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(label)) + 1):  # one label: one length
            begin = int(starts[own[0]])
            part = table.slice(begin, int(starts[own[-1]] + sizes[own[-1]]) - begin)
            first, second = _pairs_within(starts[own] - begin, sizes[own])
            tile, low, high = (part.column(k).to_numpy() for k in (5, 3, 4))
            asked = (low[first] == high[first]) | (tile[first] != tile[second])
            out = compare_pairs(part.column(1).to_numpy(), part.columns[6:], first[asked], second[asked])
            if out is not None:
                yield out

    return common.map_arrow(ordered, step, schema)


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of rows that lie in the same bucket."""
    first, second = [], []
    for size in np.unique(sizes).tolist():
        a, b = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        first.append((at + a).ravel())
        second.append((at + b).ravel())
    return np.concatenate(first), np.concatenate(second)


def _products(x: np.ndarray, y: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Inner products of rows `first` of x with rows `second` of y."""
    step = max(GATHERED // max(x.shape[1], 1), 1)
    parts = [np.einsum("ij,ij->i", x[first[k:k + step]], y[second[k:k + step]]) for k in range(0, len(first), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(kind)


def _of_bytes(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def not_ruled_out(items: DataFrame, near: Near) -> DataFrame:
    """(id, table) of vectors that a pair in that table's bucket may link, by codes alone."""
    filed = items.select("id", "label", F.posexplode("keys").alias("table", "key"), "code", "factor", "small", "scale")
    lean = np.sqrt(1 - near.cosine ** 2)

    def unpacked(columns: list) -> tuple:
        small = _of_bytes(columns[3], np.int8).astype(np.float32)
        size = small.shape[1]
        signs = np.unpackbits(_of_bytes(columns[1], np.uint8), axis=1)[:, :size].astype(np.float32) * 2 - 1
        factor, scale = columns[2].to_numpy(), columns[4].to_numpy()
        # The error shrinks as the angle does: at the wanted cosine its deviation is this one.
        error = near.sure * lean * np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / np.sqrt(max(size - 1, 1))
        return columns[0].to_numpy(), size, signs, small * scale[:, None].astype(np.float32), factor, error

    def compare(table: int, columns: list, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch | None:
        ids, size, signs, turned, factor, error = unpacked(columns)
        close = np.zeros(len(ids), bool)
        for a, b in ((first, second), (second, first)):
            guess = (signs[a] @ turned[b].T) / np.sqrt(size) / factor[a][:, None]
            hit = guess >= near.cosine - error[a][:, None] - 0.01
            hit &= a[:, None] != b[None, :]
            close[a] |= hit.any(axis=1)
            close[b] |= hit.any(axis=0)
        if not close.any():
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[close]), pa.array(np.full(close.sum(), table), pa.int32())], names=["id", "table"])

    def compare_pairs(tables: np.ndarray, columns: list, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch | None:
        ids, size, signs, turned, factor, error = unpacked(columns)
        close = np.zeros(len(ids), bool)
        for a, b in ((first, second), (second, first)):
            guess = _products(signs, turned, a, b) / np.sqrt(size) / factor[a]
            hit = guess >= near.cosine - error[a] - 0.01
            close[a[hit]] = close[b[hit]] = True
        if not close.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[close]), pa.array(tables[close], pa.int32())], names=["id", "table"])

    return by_tiles(filed, ["id", "code", "factor", "small", "scale"], near, "id long, table int", compare, compare_pairs).distinct()


def exact_links(items: DataFrame, maybe: DataFrame, near: Near) -> DataFrame:
    """(u, v, n): `n` other vectors that u links with, first met in one bucket; v is the smallest
    that a chain of links in it leads to."""
    filed = maybe.join(items, "id").select(
        "id", "label", "table", F.element_at("keys", F.col("table") + 1).alias("key"), "vector", "keys", "n")

    def compare(table: int, columns: list, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch | None:
        ids, vectors, keys, n = columns[0].to_numpy(), _matrix(columns[1]), _matrix(columns[2], np.int32), columns[3].to_numpy()
        linked = vectors[first] @ vectors[second].T >= near.cosine
        linked &= ids[first][:, None] != ids[second][None, :]
        fresh = linked.copy()
        for k in range(table):
            fresh &= keys[first, k][:, None] != keys[second, k][None, :]
        found = np.zeros(len(ids), np.int64)
        found[first] += fresh @ n[second]
        if first[0] != second[0] or len(first) != len(second):
            found[second] += fresh.T @ n[first]
        least = ids.copy()
        while True:
            before = least.copy()
            far = np.where(linked, least[second][None, :], np.iinfo(np.int64).max).min(axis=1)
            least[first] = np.minimum(least[first], far)
            far = np.where(linked, least[first][:, None], np.iinfo(np.int64).max).min(axis=0)
            least[second] = np.minimum(least[second], far)
            if (least == before).all():
                break
        return linked_rows(ids, least, found)

    def compare_pairs(tables: np.ndarray, columns: list, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch | None:
        ids, vectors, keys, n = columns[0].to_numpy(), _matrix(columns[1]), _matrix(columns[2], np.int32), columns[3].to_numpy()
        linked = (_products(vectors, vectors, first, second) >= near.cosine) & (ids[first] != ids[second])
        first, second = first[linked], second[linked]
        # The pair's first table is the first one with equal keys.
        fresh = (keys[first] == keys[second]).argmax(axis=1) == tables[first]
        found = np.zeros(len(ids), np.int64)
        np.add.at(found, first[fresh], n[second[fresh]])
        np.add.at(found, second[fresh], n[first[fresh]])
        least = ids.copy()
        while True:
            before = least.copy()
            np.minimum.at(least, first, least[second])
            np.minimum.at(least, second, least[first])
            if (least == before).all():
                break
        return linked_rows(ids, least, found)

    def linked_rows(ids: np.ndarray, least: np.ndarray, found: np.ndarray) -> pa.RecordBatch | None:
        some = np.flatnonzero((found > 0) | (least != ids))
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(least[some]), pa.array(found[some])], names=["u", "v", "n"])

    return by_tiles(filed, ["id", "vector", "keys", "n"], near, "u long, v long, n long", compare, compare_pairs)


def near_vectors(rows: DataFrame, near: Near = Near()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label)."""
    rows = rows.select("vec_id", "embedding", "label")
    named = common.stored(classes(rows), "vector-classes")
    items = common.stored(coded(named, near), "codes")
    links = common.stored(exact_links(items, not_ruled_out(items, near), near), "vector-links")
    roots = components(links.select("u", "v")).withColumnRenamed("node", "id")
    sums = links.groupBy("u").agg(F.sum("n").alias("found")).withColumnRenamed("u", "id")
    named = named.join(sums, "id", "left").join(roots, "id", "left").select(
        F.col("label").alias("own_label"), "embedding", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"),
        F.coalesce("root", "id").alias("component_id"))
    return rows.withColumn("own_label", F.when(_usable(), F.col("label"))).join(
        named, ["own_label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
