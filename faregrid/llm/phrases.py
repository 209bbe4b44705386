"""Collocations: phrases of two to five words that occur more often than their parts explain.

Texts are cut into pieces at marks and line ends, pieces into words, and counted per language:
1. blocks of words, each with its own small dictionary, are written to the shared folder;
2. the blocks' dictionaries are brought together by word and summed up; a word that is rare cannot be part of a
   frequent phrase, the others get a number there, and blocks are rewritten in these numbers;
3. for two to five words, each task counts its blocks' n-grams in quotient filters and sends them cut by
   quotient; the filters of a range are merged, and the frequent n-grams kept;
4. frequent n-grams are scored, those that a longer one holds are dropped, the rest is ranked.

An n-gram is only counted if both its parts of one word less may be frequent. That is looked up in
a table of bits, of bounded size, which holds a bit of every frequent one: a bit that is set by
another one costs a count, never a result. So nothing that is sent around whole grows with the texts.

Cases: a null or empty text has no word; a null language is `und`; repeated rows count each time;
an empty table gives no phrase; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm import common
from faregrid.llm.quotient import Filter, Packing, marks

#: Between pieces. The other separators of pieces are turned into it, so no word holds it.
BREAK = b"."
_TO_WORDS = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
RESULT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@dataclass(frozen=True)
class Mining:
    longest: int = 5
    least: int = 100
    top: int = 2000
    #: Words of one language that a block holds at most, but for a single longer text.
    block_words: int = 1 << 20
    #: Different n-grams that a task collects before it sends them.
    task_grams: int = 1 << 22
    #: Words of the corpus for each range of quotients: bounds what one merge holds.
    range_words: int = 1 << 21
    #: The table of bits has 16 for each frequent n-gram, within these powers of two.
    least_mark_bits: int = 16
    most_mark_bits: int = 26
    #: A table of words or phrases with more rows is joined by a shuffle.
    broadcast_rows: int = 1 << 17


def _language():
    return F.coalesce(F.col("lang"), F.lit("und"))


def _squeezed(ids: np.ndarray) -> bytes:
    """32-bit numbers as bytes: their lowest bytes first, then the next ones and so on, as these repeat much more
    than whole numbers do, compressed. Blocks are stored twice and sent around once, so their size counts."""
    planes = np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(ids).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[8:], 4 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def blocks(docs: DataFrame, options: Mining) -> DataFrame:
    """(block, lang, words, counts, ids): words in order of their first occurrence, how often each
    occurs, and the texts as their numbers from 1 on, 0 between pieces, squeezed."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_blocks = TaskContext.get().partitionId(), 0
        open_: dict[str, tuple[dict, list]] = {}
        sizes: dict[str, int] = defaultdict(int)

        def filled(lang: str) -> pa.RecordBatch:
            nonlocal n_blocks
            numbers, parts = open_.pop(lang)
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(numbers))[1:]
            n_blocks += 1
            del sizes[lang]
            words = [*numbers][1:]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{n_blocks}"]), pa.array([lang]),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts, pa.int64())),
                 pa.array([_squeezed(ids)], pa.binary())],
                names=["block", "lang", "words", "counts", "ids"])

        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for texts in common.text_slices(batch.column(1)):
                by_lang: dict[str, list[bytes]] = defaultdict(list)
                for lang, text in zip(langs[at:at + len(texts)], texts):
                    by_lang[lang].append(text)
                at += len(texts)
                for lang, some in by_lang.items():
                    words = BREAK.join([*some, b""]).translate(_TO_WORDS).replace(BREAK, b" . ").split()
                    if lang not in open_:
                        numbers: dict = defaultdict()
                        numbers.default_factory = numbers.__len__
                        numbers[BREAK] = 0
                        open_[lang] = numbers, []
                    numbers, parts = open_[lang]
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    sizes[lang] += len(words)
                    if sizes[lang] >= options.block_words:
                        yield filled(lang)
                # Many languages at once are as many dictionaries.
                while sum(sizes.values()) >= 4 * options.block_words:
                    yield filled(max(sizes, key=sizes.get))
        for lang in [*open_]:
            yield filled(lang)

    return common.stored(common.map_arrow(
        docs.select(_language().alias("lang"), "text"), step,
        "block string, lang string, words array<string>, counts array<long>, ids binary"), "blocks")


def listed_words(held: DataFrame, options: Mining) -> tuple[DataFrame, DataFrame]:
    """(block, lang, pos, word, a, is_new, task, inside) of every block's frequent words, `a` their count in the
    language, and (task, base): `base + inside` is a word's number from 1 on. Both are written to the shared folder.

    The shuffle that counts a word brings all blocks that hold it together, so they get its number there, without a
    join; windows keep their rows on disk where they are many, so a word may be in any number of blocks.
    """
    same = Window.partitionBy("lang", "word")
    rows = held.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select(
        "block", "lang", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    rows = rows.withColumns({"nth": F.row_number().over(same.orderBy("block", "pos")), "a": F.sum("n").over(same)})
    # A word's rows follow each other in one task: it is numbered where its first one stands.
    rows = rows.where(F.col("a") >= options.least).select(
        "block", "lang", "pos", "word", "a", (F.col("nth") == 1).cast("int").alias("is_new"),
        F.monotonically_increasing_id().alias("at"))
    rows = common.stored(rows.withColumn("task", F.shiftright("at", 33)), "listed")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("task").agg(F.sum("is_new").alias("n")).select(
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("task").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("inside", F.sum("is_new").over(upto)).drop("at")
    return common.stored(numbered, "numbered"), common.stored(tasks, "bases")


def _small(df: DataFrame, n: int, options: Mining) -> DataFrame:
    """To be broadcast if its `n` rows, which have been counted, are within the bound."""
    return F.broadcast(df) if n <= options.broadcast_rows else df


def rewritten(held: DataFrame, listed: DataFrame, bases: DataFrame) -> DataFrame:
    """(lang, ids): the blocks in the numbers of frequent words, each run of other words and breaks as one 0, squeezed."""
    names = listed.groupBy("block", "lang", "task").agg(F.collect_list(F.struct("pos", "inside")).alias("some")).join(
        F.broadcast(bases), "task")
    moved = F.transform("some", lambda x: F.struct(x["pos"].alias("pos"), (F.col("base") + x["inside"]).cast("int").alias("id")))
    names = names.groupBy("block", "lang").agg(F.flatten(F.collect_list(moved)).alias("names"))
    both = held.select("block", "lang", F.size("words").alias("n"), "ids").join(names, ["block", "lang"]).select(
        "lang", "n", "ids", "names.pos", "names.id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (lang, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                to = np.zeros(n + 1, "<i4")
                to[batch.column(3)[k].values.to_numpy() + 1] = batch.column(4)[k].values.to_numpy()
                out = to[_unsqueezed(ids)]
                out = out[np.append(True, (out[1:] != 0) | (out[:-1] != 0))]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([_squeezed(out)], pa.binary())], names=["lang", "ids"])

    return common.stored(common.map_arrow(both, step, "lang string, ids binary"), "rewritten")


def _may_be(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (64 * len(table) - 1)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def grams_of(ids: np.ndarray, packing: Packing, shorter: np.ndarray | None) -> list[np.ndarray]:
    """The packed n-grams of a block without a 0, whose parts of one word less may be frequent."""
    k = packing.k
    if len(ids) < k:
        return [np.empty(0, np.uint64)] * len(packing.lane_bits)
    gaps = np.concatenate(([0], np.cumsum(ids == 0)))
    good = gaps[k:] == gaps[:-k]
    if shorter is not None:
        parts = Packing(k - 1, packing.bits).pack(ids)
        known = _may_be(shorter, marks(parts))
        good &= known[:-1] & known[1:]
    return [lane[good] for lane in packing.pack(ids)]


def counted(corpus: DataFrame, packing: Packing, shorter: np.ndarray | None, options: Mining) -> DataFrame:
    """(lang, ids, a, mark) of the n-grams that occur often enough, written to the shared folder."""
    shared = corpus.sparkSession.sparkContext.broadcast(shorter)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Filter]] = defaultdict(list)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, filters in held.items():
                for name, file in Filter.merge(filters).pieces():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([name], pa.int32()), pa.array([file], pa.binary())],
                        names=["lang", "part", "file"])
            held.clear()

        for batch in batches:
            for lang, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[lang].append(Filter.of(packing, grams_of(_unsqueezed(ids.as_py()), packing, shared.value)))
                if sum(map(len, held[lang])) >= options.task_grams // 4:
                    held[lang] = [Filter.merge(held[lang])]
                if sum(len(f) for filters in held.values() for f in filters) >= options.task_grams:
                    yield from sent()
        yield from sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, files = None, []

        def merged() -> pa.RecordBatch:
            found = Filter.merge([Filter.read(packing, name[1], file) for file in files]).at_least(options.least)
            grams = found.grams()
            return pa.RecordBatch.from_arrays(
                [pa.array([name[0]] * len(found), pa.string()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * packing.k, pa.int32()),
                                          pa.array(packing.unpack(grams).ravel(), pa.int32())),
                 pa.array(found.counts, pa.int64()), pa.array(marks(grams), pa.int64())],
                names=["lang", "ids", "a", "mark"])

        for batch in batches:
            for *own, file in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if own != name:
                    if files:
                        yield merged()
                    name, files = own, []
                files.append(file)
        if files:
            yield merged()

    files = common.map_arrow(corpus, count, "lang string, part int, file binary")
    files = files.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return common.stored(common.map_arrow(files, merge, "lang string, ids array<int>, a long, mark long"), f"grams{packing.k}")


def marked(grams: DataFrame, options: Mining) -> np.ndarray | None:
    """The table of bits of these n-grams; None if there are none.

    Brings one number for each 64 bits of the table to the driver, at most 2 ** (most_mark_bits - 6).
    """
    n = grams.count()
    if not n:
        return None
    bits = min(max((16 * n).bit_length(), options.least_mark_bits), options.most_mark_bits)
    at = F.col("mark").bitwiseAND((1 << bits) - 1)
    rows = grams.select(F.shiftright(at, 6).alias("w"), at.bitwiseAND(63).cast("int").alias("b")).select(
        "w", F.expr("shiftleft(1L, b)").alias("bit"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for row in rows.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():
        table[row["w"]] = row["bits"]
    return table


def _longer(grams: DataFrame) -> DataFrame:
    """(lang, ids, most): how often the most frequent phrase of one word more that holds a phrase occurs.

    If any longer phrase that holds it is as frequent, one of these is.
    """
    parts = F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))
    return grams.where("size(ids) > 2").select("lang", F.explode(parts).alias("ids"), "a").groupBy("lang", "ids").agg(
        F.max("a").alias("most"))


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words and more that no longer one stands for, with their weakest cut."""
    phrases = grams.where("size(ids) > 1")
    free = phrases.join(_longer(phrases), ["lang", "ids"], "left").where("most is null or 100 * most < 100 * a")
    cuts = free.select("lang", "ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k")).select(
        "*", F.expr("slice(ids, 1, k)").alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    first = grams.select("lang", F.col("ids").alias("first"), F.col("a").alias("l"))
    rest = grams.select("lang", F.col("ids").alias("rest"), F.col("a").alias("r"))
    # 1000 * a * n may need over 64 bits; decimals of up to 38 digits hold it.
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(15,0)))"
                   " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    cuts = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(F.broadcast(totals), "lang")
    return cuts.select("lang", "ids", "a", "n", "k", "l", "r", score.cast("long").alias("score")).groupBy("lang", "ids", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "ids", "a", "n", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, options: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of every language."""
    held = blocks(docs, options)
    totals = common.stored(held.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda n, k: n + k).alias("n")).groupBy(
        "lang").agg(F.sum("n").alias("n")), "totals")
    listed, bases = listed_words(held, options)
    dictionary = listed.where("is_new = 1").join(F.broadcast(bases), "task").select(
        "lang", "word", (F.col("base") + F.col("inside")).cast("int").alias("id"), "a")
    n_words = dictionary.count()
    bits = max(n_words, 1).bit_length()
    if bits > 31:
        raise ValueError("over 2**31 frequent words: raise `least`")
    corpus = rewritten(held, listed, bases)
    n_all = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    range_bits = max(0, (n_all // options.range_words).bit_length())
    found, shorter = [dictionary.select("lang", F.array("id").alias("ids"), "a")], None
    for k in range(2, options.longest + 1):
        grams = counted(corpus, Packing(k, bits, range_bits), shorter, options)
        found.append(grams.select("lang", "ids", "a"))
        shorter = marked(grams, options)
        if shorter is None:
            break
    best = common.stored(scored(reduce(DataFrame.unionAll, found), totals), "scored")
    names = _small(dictionary.select("id", "word"), n_words, options)
    spelled = best.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(names, "id").groupBy("lang", "ids").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
    best = best.join(spelled, ["lang", "ids"]).withColumn("phrase", F.array_join("words.word", " "))
    # Each share of a language keeps its own first ones before the language is put in order.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = best.withColumn("share", share).withColumn("place", F.row_number().over(
        Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= options.top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= options.top).select(*RESULT)
