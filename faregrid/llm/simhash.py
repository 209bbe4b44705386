"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints.

A fingerprint is cut into eight blocks of eight bits. Two that differ in at most two bits
agree on some six blocks, so each fingerprint is filed once under every choice of six blocks;
fingerprints in one bucket are then compared by their Hamming distance. Since a bucket fixes
48 bits, it cannot hold more than 65,536 different fingerprints, whatever the data.

Documents with the same fingerprint are one class throughout: only classes are compared, and
links are kept as chains within a bucket, never as all pairs.

Cases: a null or wordless text has fingerprint 0 and is linked like any other; documents
without id count as members but cannot name a component (null if it has no other); repeated
rows each get their row; an input column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faregrid.llm import common
from faregrid.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BLOCKS = 8
_LANES = np.uint64(0x0101010101010101)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of words, repeats included; fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps[shingle - 1:].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))


def fingerprint_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes.

    Eight byte-wide counters fit in a word, so runs of 255 hashes are added without overflow.
    """
    if not len(hashes):
        return 0
    runs = np.arange(0, len(hashes), 255)
    totals = np.zeros((8, 8), np.int64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, runs)
        totals[:, k] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = totals.reshape(64) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with `fp`, the fingerprint as a signed long."""
    kept = common.kept_columns(docs, ["fp"])
    at = kept.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_bits(_hashes(text, shingle))
                     for texts in common.text_slices(batch.column(at)) for text in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*kept, "fp"])

    return common.map_arrow(docs.select(*map(common.quoted, kept)), mark,
                            common.extended(docs, kept, [("fp", T.LongType())]))


def _near(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of one bucket's fingerprints, the smallest that a chain of links leads to.

    Rows of the distance matrix are formed in pieces, so memory follows the bucket's size.
    """
    n = len(fps)
    values = fps.view(np.uint64)
    label = np.arange(n)
    step = max(1, (1 << 20) // n)
    while True:
        before = label.copy()
        for i in range(0, n, step):
            close = np.bitwise_count(values[i:i + step, None] ^ values[None, :]) <= max_bits
            label[i:i + step] = np.minimum(
                label[i:i + step], np.where(close, label[None, :], n).min(axis=1))
        label = label[label]
        if (label == before).all():
            return fps[label]


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(u, v) over different fingerprints: v is the smallest one that u is chained to within a
    bucket. Their closure is the closure of all links."""
    width = 64 // blocks
    masks = []
    for left_out in combinations(range(blocks), max_bits):
        mask = (1 << 64) - 1
        for block in left_out:
            mask ^= ((1 << width) - 1) << (block * width)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    filed = fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(k).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits"))
        for k, mask in enumerate(masks)))).alias("at")).select("at.choice", "at.bits", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3  # the last bucket of a batch may go on in the next one
        for batch in batches:
            table = [np.concatenate((old, c.to_numpy(zero_copy_only=False)))
                     for old, c in zip(rest, batch.columns)]
            new = np.flatnonzero((np.diff(table[0]) != 0) | (np.diff(table[1]) != 0)) + 1
            last = int(new[-1]) if len(new) else 0
            yield from _compared(table[2][:last], np.concatenate(([0], new)))
            rest = [x[last:] for x in table]
        yield from _compared(rest[2], np.array([0, len(rest[2])]))

    def _compared(fp: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        several = np.flatnonzero(np.diff(bounds) > 1)
        u, v = [], []
        for a, b in zip(bounds[several].tolist(), bounds[several + 1].tolist()):
            own = np.sort(fp[a:b])
            root = _near(own, max_bits)
            u.append(own[root != own])
            v.append(root[root != own])
        if u:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    # Equal (choice, bits) are neighbours after the sort; a bucket is bounded by its free bits.
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = filed.repartition(n, "choice", "bits").sortWithinPartitions("choice", "bits")
    return common.map_arrow(ordered, compare, "u long, v long")


def _named(classes: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least) with the smallest `least` of each fingerprint's component."""
    roots = components(links(classes.select("fp"), max_bits))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    return linked.select("fp", "root").join(
        linked.groupBy("root").agg(F.min("least").alias("least")), "root").select("fp", "least")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """`doc_id`, `fp` and `component_id` of every row of `docs`."""
    marked = common.stored(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fps")
    classes = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-classes")
    named = _named(classes, max_bits).withColumnRenamed("least", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with one row left of each component: the one with the smallest id, and of several
    rows with that id (or all without one) the one with the smallest hash over its columns."""
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    keys = [common.free_name(docs, name) for name in ("row_id", "row_hash")]
    keyed = docs.withColumns({keys[0]: F.coalesce("doc_id", F.lit(0)),
                              keys[1]: F.xxhash64(*map(common.quoted, plain))})
    marked = common.stored(fingerprints(keyed.select("doc_id", *keys, "text"), shingle).drop("text"), "fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), *(F.col(k) for k in keys)))
    classes = common.stored(marked.groupBy("fp").agg(first.alias("least")), "fp-classes")
    stays = _named(classes, max_bits).select(*(F.col(f"least.{k}").alias(k) for k in keys)).distinct()
    return keyed.join(stays, keys, "left_semi").dropDuplicates(keys).select(*map(common.quoted, docs.columns))
