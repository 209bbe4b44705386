"""Ranked search of many queries ("items") over all documents, by presence masks.

Documents are read once into postings of the items' terms. For every item, a block's documents are
grouped by the mask of the item's terms that they hold: bit k of a mask is set by the posting list
of the k-th term. A group's score is bounded by its mask, the largest count of each term and its
shortest document; groups are scored by descending bound until the k-th best score found is above
all that is left. The best of each task are merged. Nothing is cut: a group that may still hold a
result is scored, and items of any number of terms are masked in slices.

Items are taken in blocks of bounded size, whose terms are all that is broadcast.

Cases: a null or empty text holds no term; documents without terms count nowhere; an item without
terms, or whose terms no document holds, has no result; repeated document rows are ranked each,
equal scores by id, null ids last; items repeated with id and text count once, other texts of an
id are items of their own; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm import common

#: Terms are runs of ASCII letters and digits and of all bytes above ASCII; A-Z are lowered.
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_TO_TERMS = bytes(b if b >= 128 or 48 <= b <= 57 or b in _LETTERS else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Terms of one slice of a mask.
SLICE_TERMS = 63
RESULT = "item_id long, rank int, doc_id long, score long"


@dataclass(frozen=True)
class Search:
    top: int = 10
    #: Items that are ranked together, and (item, term) entries: what one broadcast holds at most,
    #: but for a single longer item.
    block_items: int = 1024
    block_terms: int = 1 << 18
    #: Documents, and postings, that a task groups at once.
    block_docs: int = 1 << 15
    block_postings: int = 1 << 22


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_TERMS).split()


def item_blocks(items: DataFrame, options: Search) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """Items as (item_id, their terms with counts), a block at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        counts = Counter(terms_of((row["text"] or "").encode()))
        if block and (len(block) >= options.block_items or size + len(counts) > options.block_terms):
            yield block
            block, size = [], 0
        block.append((row["item_id"], dict(counts)))
        size += len(counts)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n_terms, terms, counts) of every document that holds a term at all: how many it
    has, the vocabulary's places in it and their occurrences. Written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast({term: k for k, term in enumerate(vocabulary)})

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            at = 0
            for texts in common.text_slices(batch.column(1)):
                kept, sizes, ends, terms, counts = [], [], [0], [], []
                for k, text in enumerate(texts, at):
                    found = terms_of(text)
                    if found:
                        held = Counter(map(place, found))
                        held.pop(None, None)
                        kept.append(k)
                        sizes.append(len(found))
                        terms.extend(held)
                        counts.extend(held.values())
                        ends.append(len(terms))
                at += len(texts)
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))],
                    names=["doc_id", "n_terms", "terms", "counts"])

    return common.stored(common.map_arrow(
        docs.select("doc_id", "text"), step, "doc_id long, n_terms long, terms array<int>, counts array<int>"), "postings")


@dataclass
class Ranking:
    """What scoring needs: per item its id, its terms and their factors; the corpus' totals."""

    items: list[tuple[int, np.ndarray, np.ndarray]]
    n_docs: int
    n_terms: int

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """Each document's m; in whole numbers of any size, once per different length."""
        distinct, place = np.unique(sizes, return_inverse=True)
        return np.array([25 + 75 * n * self.n_docs // self.n_terms for n in distinct.tolist()], np.int64)[place]


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranking(index: DataFrame, vocabulary: list[bytes], block: list[tuple[int, dict[bytes, int]]]) -> Ranking:
    """Brings one row per term of the block to the driver."""
    totals = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    df = {row["term"]: row["n"] for row in index.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n")).collect()}
    place = {term: k for k, term in enumerate(vocabulary)}
    items = []
    for item_id, counts in block:
        # A term of weight 0, or that no document holds, adds to no score.
        factors = {place[t]: n * term_weight(totals["n"], df[place[t]]) for t, n in counts.items() if place[t] in df}
        factors = {t: f for t, f in factors.items() if f}
        items.append((item_id, np.fromiter(factors, np.int64), np.fromiter(factors.values(), np.int64)))
    return Ranking(items, totals["n"], totals["l"])


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Block:
    """Documents of a task, their terms turned into posting lists."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, m: np.ndarray, first: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_vocabulary: int):
        self.ids, self.no_id, self.m = ids, no_id, m
        docs = np.repeat(np.arange(len(ids)), np.diff(first))
        order = np.argsort(terms, kind="stable")
        self.docs, self.counts = docs[order], counts[order].astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=n_vocabulary))))

    def of_term(self, term: int) -> slice:
        return slice(self.first[term], self.first[term + 1])

    def groups(self, terms: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents by group, where each group begins among them, the most its documents may score).

        Documents that hold none of the terms are in no group.
        """
        n = len(self.ids)
        group, bound = np.zeros(n, np.int64), None
        slices = [range(a, min(a + SLICE_TERMS, len(terms))) for a in range(0, len(terms), SLICE_TERMS)]
        masks = []
        for own in slices:
            mask = np.zeros(n, np.int64)
            for bit, k in enumerate(own):
                mask[self.docs[self.of_term(terms[k])]] |= 1 << bit
            masks.append(mask)
            # Groups of the slices before are split by this one's masks.
            distinct, place = np.unique(mask, return_inverse=True)
            group = np.unique(group * len(distinct) + place, return_inverse=True)[1] if len(slices) > 1 else place
        order = np.argsort(group, kind="stable")
        begins = np.flatnonzero(np.diff(group[order], prepend=-1))
        shortest = np.minimum.reduceat(self.m[order], begins) if n else begins
        bound, held = np.zeros(len(begins), np.int64), np.zeros(len(begins), bool)
        for own, mask in zip(slices, masks):
            mask = mask[order[begins]]
            held |= mask != 0
            for bit, k in enumerate(own):
                counts = self.counts[self.of_term(terms[k])]
                if len(counts):
                    bound += ((mask >> bit) & 1) * factors[k] * _gain(counts.max(), shortest)
        ends = np.append(begins[1:], n)
        sizes = (ends - begins)[held]
        return order[np.repeat(held, ends - begins)], np.concatenate(([0], np.cumsum(sizes))), bound[held]

    def scores(self, docs: np.ndarray, terms: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Exact scores of the given documents."""
        out, place = np.zeros(len(docs), np.int64), np.full(len(self.ids), -1)
        place[docs] = np.arange(len(docs))
        for term, factor in zip(terms, factors):
            own = self.of_term(term)
            at = place[self.docs[own]]
            hit = at >= 0
            at = at[hit]
            out[at] += factor * _gain(self.counts[own][hit], self.m[docs[at]])
        return out

    def best(self, terms: np.ndarray, factors: np.ndarray, top: int, found: list[tuple]) -> list[tuple]:
        """`found`, the (-score, no id, id) of earlier blocks, and this one's: the first `top`."""
        docs, begins, bound = self.groups(terms, factors)
        order = np.argsort(-bound, kind="stable")
        at, some = 0, top
        while at < len(order):
            # Groups of equal bound as the last result may hold one of the same score and a smaller id.
            if bound[order[at]] <= 0 or (len(found) == top and bound[order[at]] < -found[-1][0]):
                break
            taken, n = [], 0
            while at < len(order) and n < some:
                taken.append(order[at])
                n += begins[order[at] + 1] - begins[order[at]]
                at += 1
            some *= 2
            rows = np.concatenate([docs[begins[g]:begins[g + 1]] for g in taken])
            scores = self.scores(rows, terms, factors)
            if len(found) == top:
                good = scores >= -found[-1][0]
            else:
                good = scores > 0
            rows, scores = rows[good], scores[good]
            first = np.lexsort((self.ids[rows], self.no_id[rows], -scores))[:top]
            found = sorted(found + [*zip((-scores[first]).tolist(), self.no_id[rows[first]].tolist(), self.ids[rows[first]].tolist())])[:top]
        return found


def rank_block(index: DataFrame, stats: Ranking, n_vocabulary: int, options: Search) -> DataFrame:
    """The best documents of a block of items."""
    shared = index.sparkSession.sparkContext.broadcast(stats)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = shared.value
        best: list[list[tuple]] = [[] for _ in stats.items]

        def search(held: list[pa.RecordBatch]) -> None:
            ids, sizes = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
            lists = [[b.column(k) for b in held] for k in (2, 3)]
            first = np.concatenate(([0], np.cumsum(np.concatenate([x.value_lengths().to_numpy() for x in lists[0]]))))
            terms, counts = (np.concatenate([x.flatten().to_numpy() for x in column]) for column in lists)
            block = Block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                          stats.lengths(sizes.to_numpy()), first, terms, counts, n_vocabulary)
            for k, (_, own, factors) in enumerate(stats.items):
                best[k] = block.best(own, factors, options.top, best[k])

        held, n_docs, n_postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            n_docs += len(batch)
            n_postings += len(batch.column(2).flatten())
            if n_docs >= options.block_docs or n_postings >= options.block_postings:
                search(held)
                held, n_docs, n_postings = [], 0, 0
        if n_docs:
            search(held)
        rows = [(k, stats.items[k][0], None if no_id else doc_id, -score)
                for k, found in enumerate(best) for score, no_id, doc_id in found]
        columns = [*zip(*rows)] or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
            names=["place", "item_id", "doc_id", "score"])

    found = common.map_arrow(index, step, "place int, item_id long, doc_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top).select(
        "item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, options: Search = Search()) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of every item."""
    spark, parts = docs.sparkSession, []
    for block in item_blocks(items, options):
        vocabulary = sorted({term for _, counts in block for term in counts})
        index = postings(docs, vocabulary)
        parts.append(rank_block(index, ranking(index, vocabulary, block), len(vocabulary), options))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], RESULT)
