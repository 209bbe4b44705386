"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text's features are its words, word pairs, word shapes, pairs of shapes and a mark for words that
repeat the one before, each hashed to a bucket; a shape is a word with its letters and digits
reduced to their class and runs shortened to one. A feature's value is 1 + log(count), and a text's
values have length one. The label is learned per coordinate: every bucket has its own learning rate
and is pulled to zero until the evidence outweighs `l1`. A score is one sparse dot product.

The sample is dealt to a fixed number of shards by hash. In each round all shards go through their
texts in hash order, each from the mean state of the round before, so the result depends neither on
partitions nor on lost tasks. Only the sample is bounded (`train_limit`); every text is scored.

Cases: a null or empty text has the constant feature alone; without any label all scores are 0.5;
several labels of a document count as their mean, other values than 0 and 1 as none; of several
texts with a labelled id the first in byte order is learned; repeated rows each get their row; a
null id is held out (its text form is taken as empty); an input column named like a result column
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faregrid.llm import common
from faregrid.llm.common import mixed
from faregrid.llm.words import Words, span_hashes

RESULTS = [("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType())]

#: The class of each byte: small letters and bytes above ASCII, capitals, digits; marks are their own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
#: Keeps the kinds of feature apart before they share the buckets.
_KINDS = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, 6)]


@dataclass(frozen=True)
class Classifier:
    buckets: int = 1 << 18
    #: At most so many labelled documents are learned, those with the smallest hashes of their id.
    train_limit: int = 10_000
    shards: int = 4
    rounds: int = 5
    alpha: float = 10.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    #: Documents whose crc32 of the id, modulo this, is 0 are never learned.
    folds: int = 5
    threshold: float = 0.3


@dataclass
class State:
    """Per bucket, and last for the constant: summed gradients less the weights' share, and summed squares."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls, model: Classifier) -> State:
        return cls(np.zeros(model.buckets + 1), np.zeros(model.buckets + 1))

    def weights(self, model: Classifier, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (model.beta + np.sqrt(n)) / model.alpha + model.l2
        return np.where(np.abs(z) <= model.l1, 0.0, (np.sign(z) * model.l1 - z) / rate)

    def learn(self, at: np.ndarray, values: np.ndarray, label: float, model: Classifier) -> None:
        """One text's update; `at` holds every bucket once."""
        w, n = self.weights(model, at), self.n[at]
        slope = (logistic(w @ values) - label) * values
        self.z[at] += slope - (np.sqrt(n + slope * slope) - np.sqrt(n)) / model.alpha * w
        self.n[at] += slope * slope


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(texts: list[bytes], model: Classifier) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of all features but the constant, by text and bucket."""
    words = Words(texts)
    word, text = words.hashes(), words.text_of_word()
    kind = _CLASS[words.data]
    kept = np.ones(len(kind), bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[words.starts] = True
    place = np.concatenate(([0], np.cumsum(kept)))
    shape = span_hashes(kind[kept], place[words.starts], place[words.ends])
    inside = text[1:] == text[:-1]
    again = inside & (word[1:] == word[:-1])
    grams = [(word, text), ((word[:-1] * np.uint64(3) + word[1:])[inside], text[1:][inside]),
             (shape, text), ((shape[:-1] * np.uint64(3) + shape[1:])[inside], text[1:][inside]),
             (np.zeros(int(again.sum()), np.uint64), text[1:][again])]
    bucket = np.concatenate([mixed(h + kind) % np.uint64(model.buckets) for (h, _), kind in zip(grams, _KINDS)])
    owner = np.concatenate([t for _, t in grams])
    entries, count = np.unique(owner * model.buckets + bucket.astype(np.int64), return_counts=True)
    owner, bucket = entries // model.buckets, entries % model.buckets
    values = 1 + np.log(count)
    length = np.sqrt(np.bincount(owner, values * values, len(texts)))
    return owner, bucket, values / length[owner]


def held_out(model: Classifier) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % model.folds == 0


def training_rows(docs: DataFrame, labels: DataFrame, model: Classifier) -> DataFrame:
    """(shard, place, label, buckets, values) of the sample, written to the shared folder."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(model))
    sample = known.groupBy("doc_id").agg(F.avg("quality").alias("label")).withColumn(
        "place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(model.train_limit)
    texts = docs.select("doc_id", common.whole_text().alias("text")).join(
        F.broadcast(sample), "doc_id").groupBy("doc_id", "place", "label").agg(F.min("text").alias("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in common.text_slices(batch.column(3)):
                owner, bucket, values = features(some, model)
                first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(some))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, len(some)) for k in range(3)),
                     pa.ListArray.from_arrays(first, pa.array(bucket, pa.int32())),
                     pa.ListArray.from_arrays(first, pa.array(values))],
                    names=["doc_id", "place", "label", "buckets", "values"])
                at += len(some)

    rows = common.map_arrow(texts, step, "doc_id long, place long, label double, buckets array<int>, values array<double>")
    shard = F.pmod("place", F.lit(model.shards)).cast("int")
    return common.stored(rows.select(shard.alias("shard"), "place", "doc_id", "label", "buckets", "values"), "training")


def train(docs: DataFrame, labels: DataFrame, model: Classifier = Classifier()) -> State:
    """The state after all rounds; one row per shard, of a size that the parameters fix, comes
    to the driver in each."""
    rows = training_rows(docs, labels, model)
    ordered = rows.repartition(model.shards, "shard").sortWithinPartitions("shard", "place", "doc_id")
    context, state = docs.sparkSession.sparkContext, State.empty(model)
    for _ in range(model.rounds):
        shared = context.broadcast(state)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, shard = None, None

            def done() -> pa.RecordBatch:
                at = np.flatnonzero(own.n)
                return pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at, own.z[at], own.n[at]))],
                    names=["shard", "at", "z", "n"])

            for batch in batches:
                lists = batch.column(2), batch.column(3)
                for k, (number, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    if number != shard:
                        if own is not None:
                            yield done()
                        own, shard = State(shared.value.z.copy(), shared.value.n.copy()), number
                    at, values = (x[k].values.to_numpy(zero_copy_only=False) for x in lists)
                    own.learn(np.append(at, model.buckets), np.append(values, 1.0), label, model)
            if own is not None:
                yield done()

        found = sorted(common.map_arrow(ordered.select("shard", "label", "buckets", "values"), step,
                                        "shard int, at binary, z binary, n binary").collect())
        if not found:
            break
        state = State.empty(model)
        for row in found:
            at = np.frombuffer(row["at"], np.int64)
            state.z[at] += np.frombuffer(row["z"]) / len(found)
            state.n[at] += np.frombuffer(row["n"]) / len(found)
        shared.unpersist()
    return state


def score(docs: DataFrame, state: State, model: Classifier = Classifier()) -> DataFrame:
    """`docs` with `held_out`, `score` and `predicted`."""
    kept = common.kept_columns(docs, [name for name, _ in RESULTS])
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(state.weights(model))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            found = [np.empty(0)]
            for texts in common.text_slices(batch.column(at)):
                owner, bucket, values = features(texts, model)
                found.append(logistic(np.bincount(owner, values * weights[bucket], len(texts)) + weights[-1]))
            scores = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= model.threshold).astype(np.int32))],
                names=[*kept, "held_out", "score", "predicted"])

    marked = docs.select(*map(common.quoted, kept), held_out(model).alias("held_out"))
    return common.map_arrow(marked, step, common.extended(docs, kept, RESULTS))


def classify(docs: DataFrame, labels: DataFrame, model: Classifier = Classifier()) -> DataFrame:
    return score(docs, train(docs, labels, model), model)
