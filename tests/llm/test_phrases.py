"""Quotient filters and collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import empty_documents, odd_documents, with_clashes
from pyspark.sql import functions as F

from faregrid.llm import phrases, quotient
from faregrid.llm.phrases import Mining
from faregrid.llm.quotient import Filter, Packing

PACKINGS = [Packing(k, bits, range_bits, slots) for k in (2, 3, 5) for bits, range_bits, slots in ((1, 3, 10), (5, 0, 4), (12, 4, 10), (17, 7, 10), (31, 2, 6))]


@pytest.mark.parametrize("packing", PACKINGS)
def test_permutation_is_undone(packing):
    rng = np.random.default_rng(packing.bits)
    ids = rng.integers(0, 1 << packing.bits, 500).astype(np.int32)
    lanes = packing.pack(ids)
    assert (packing.unpack(lanes) == np.lib.stride_tricks.sliding_window_view(ids, packing.k)).all()
    moved = packing.permute(lanes)
    assert all((a == b).all() for a, b in zip(packing.restore(moved), lanes))
    assert all(int(lane.max()) < 1 << n for lane, n in zip(moved, packing.lane_bits))
    assert len({*zip(*(m.tolist() for m in moved))}) == len({*zip(*(lane.tolist() for lane in lanes))})


def test_every_value_of_a_small_domain_is_met_once():
    packing = Packing(2, 7)
    every = [np.arange(1 << 14, dtype=np.uint64)]
    moved = packing.permute(every)[0]
    assert (np.sort(moved) == every[0]).all()
    # Neighbours are dealt over all ranges.
    assert np.bincount((moved[:1024] >> np.uint64(10)).astype(int), minlength=16).min() > 20


@pytest.mark.parametrize("packing", PACKINGS)
def test_merged_files_count_exactly(packing):
    rng = random.Random(packing.k * 100 + packing.bits)
    top = min(1 << packing.bits, 40)
    shards = [[rng.randrange(top) for _ in range(n)] for n in (0, 1, 4, 700, 2000)] + [[3 % top] * 400]
    want, files = Counter(), defaultdict(list)
    for shard in shards:
        want.update(zip(*(shard[j:] for j in range(packing.k))))
        for name, file in Filter.of(packing, packing.pack(np.array(shard, np.int32))).pieces():
            files[name].append(file)
    found = Counter()
    for name, own in files.items():
        merged = Filter.merge([Filter.read(packing, name, file) for file in own])
        assert len({*zip(*(lane.tolist() for lane in merged.lanes))}) == len(merged)
        found.update(dict(zip(map(tuple, packing.unpack(merged.grams()).tolist()), merged.counts.tolist())))
    assert found == want
    assert len(files) <= 1 << packing.shared_bits


def test_files_are_compact():
    packing = Packing(2, 16, 0, 12)
    ids = np.random.default_rng(1).integers(1, 1 << 16, 20_000).astype(np.int32)
    (_, file), = Filter.of(packing, packing.pack(ids)).pieces()
    assert len(file) < 20_000 * 4 + (4 << 12) + 100


def expected(docs, options):
    n, f = Counter(), Counter()
    lower = {k: k + 32 for k in range(65, 91)}
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, options.longest + 1):
                f.update((lang, w) for w in zip(*(words[j:] for j in range(k))))
    held = {p: a for p, a in f.items() if a >= options.least}
    most = Counter()
    for (lang, w), a in held.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    most[lang, w[i:j]] = max(most[lang, w[i:j]], a)
    rows = []
    for (lang, w), a in held.items():
        if len(w) > 1 and most[lang, w] < a:
            score, k = min((1000 * a * n[lang] // (held[lang, w[:k]] * held[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((lang, -score, -a, " ".join(w).encode(), held[lang, w[:k]], held[lang, w[k:]], n[lang]))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == lang)[:options.top]
        out += [(lang, k, p.decode(), -a, left, right, n_, -s) for k, (_, s, a, p, left, right, n_) in enumerate(own, 1)]
    return sorted(out)


def documents(spark):
    rng = random.Random(9)
    extra = []
    for k in range(150):
        words = [rng.choice("the of Big APPLE pie é 中文 a's \x1c x\x00y".split(" ")) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " big apple pie of the "]) for w in words)
        extra.append((6000 + k, text, rng.choice(["en", "xx", None, "und", ""]), "s", 0))
    extra += [(7000, "a b c d e f " * 3000, "long", "s", 0), (7001, "!?.,;:", "long", None, 0), (7002, "one two " * 7, "rare", None, 0)]
    docs = odd_documents(spark)
    return docs.unionAll(spark.createDataFrame(extra, docs.schema))


@pytest.mark.parametrize("options", [
    Mining(), Mining(least=12), Mining(least=12, top=7),
    Mining(least=12, block_words=50, task_grams=200, range_words=100, broadcast_rows=0),
    Mining(least=5, longest=3, least_mark_bits=6, most_mark_bits=6)])
def test_matches_plain_python(spark, options):
    docs = documents(spark)
    found = phrases.collocations(docs.repartition(3), options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = expected([(r.text, r.lang) for r in docs.collect()], options)
    assert sorted(map(tuple, found.collect())) == want and want


@pytest.mark.parametrize("ids", [[], [0], [1, 0, 2 ** 31 - 1] * 5, [*range(70_000)], [7] * 1000])
def test_squeezed_numbers_come_back(ids):
    found = phrases._unsqueezed(phrases._squeezed(np.array(ids, np.int64)))
    assert found.dtype == np.dtype("<i4") and found.tolist() == ids


def test_stored_blocks_are_small(spark):
    """Of words that hardly repeat a block holds far less than four bytes each, before and after they are renumbered."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(4000)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(vocabulary, k=3000)), "en", "s", 0) for k in range(40)], documents(spark).schema)
    options = Mining(least=3, block_words=40_000)
    held = phrases.blocks(docs.repartition(2), options)
    corpus = phrases.rewritten(held, *phrases.listed_words(held, options))
    for df in (held, corpus):
        assert 0 < df.selectExpr("sum(octet_length(ids))").first()[0] < 2 * 120_000
    words = [w for r in held.collect() for i in phrases._unsqueezed(r.ids).tolist() if i for w in (r.words[i - 1],)]
    assert Counter(words) == Counter(w for r in docs.collect() for w in r.text.split())


def test_words_of_blocks_get_their_numbers_without_a_lookup(spark):
    """One number per frequent word in all blocks that hold it, from 1 on without gaps; no join has the words as key."""
    options = Mining(least=12, block_words=50, broadcast_rows=0)
    held = phrases.blocks(documents(spark).repartition(3), options)
    counts, at, langs = Counter(), {}, {}
    for r in held.collect():
        langs[r.block] = r.lang
        for pos, (word, n) in enumerate(zip(r.words, r.counts)):
            counts[r.lang, word] += n
            at[r.block, pos] = word
    listed, bases = phrases.listed_words(held, options)
    rows = listed.join(bases, "task").withColumn("id", F.expr("base + inside")).collect()
    frequent = {w for w, n in counts.items() if n >= 12}
    assert len(rows) == sum((langs[block], word) in frequent for (block, _), word in at.items())
    assert all(at[r.block, r.pos] == r.word and langs[r.block] == r.lang and counts[r.lang, r.word] == r.a for r in rows)
    numbers = {(r.lang, r.word, r.id) for r in rows}
    assert sorted(i for *_, i in numbers) == [*range(1, len(frequent) + 1)] and {w[:2] for w in numbers} == frequent
    assert sorted((r.lang, r.word) for r in rows if r.is_new) == sorted(frequent) and len(rows) > 2 * len(frequent)


def test_wide_products_are_exact(spark):
    grams = spark.createDataFrame([("x", [1], 4 * 10 ** 12), ("x", [2], 3 * 10 ** 12), ("x", [1, 2], 10 ** 12 + 7)], "lang string, ids array<int>, a long")
    totals = spark.createDataFrame([("x", 9 * 10 ** 12)], "lang string, n long")
    row, = phrases.scored(grams, totals).collect()
    assert row.score == 1000 * (10 ** 12 + 7) * 9 * 10 ** 12 // (12 * 10 ** 24)


def test_marks_hold_every_frequent_gram():
    packing = Packing(3, 20)
    lanes = packing.pack(np.random.default_rng(2).integers(1, 1 << 20, 5000).astype(np.int32))
    hashes = quotient.marks(lanes)
    table = np.zeros(1 << 10, np.int64)
    for h in hashes & 0xFFFF:
        table[h >> 6] |= np.int64(np.uint64(1) << np.uint64(h & 63))
    assert phrases._may_be(table, hashes).all()


def test_empty_tables_and_clashing_columns(spark):
    assert phrases.collocations(empty_documents(spark)).count() == 0
    docs, options = documents(spark), Mining(least=12)
    clash = with_clashes(docs, "block", "words", "ids", "rank", "phrase", "a", "n", "word", "id")
    assert sorted(phrases.collocations(clash, options).collect()) == sorted(phrases.collocations(docs, options).collect())
