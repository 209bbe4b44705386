"""Byte BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import empty_documents, odd_documents, with_clashes
from tokenizers import Tokenizer

from faregrid.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "A", " ", "  ", "\n", "\t", "\x85", "\xa0", " ", "　", "\x1c", "\x1f", "\x0b", "é", "😀", "'s", "'ll",
         "'", "1", "٣", "中文", "ñ", "<|endoftext|>", "<|", "!", "!!", "the", " the", "ing", "́", "﻿", "​", "ａ", "𝒜", "²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(PATH))


def texts(n=3000):
    rng = random.Random(1)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return out + ["a" * 5000, "ab" * 3000, " " * 1000, "xxx" + "\n" * 50 + " y", "0123456789abcdef" * 500, "é" * 3000]


def test_round_trip_and_ids(vocabulary, library):
    every = texts()
    found = vocabulary.encode(every)
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert [np.frombuffer(f, np.int32).tolist() for f in found] == want
    for text, ids in zip(every, want):
        assert vocabulary.decode(np.array(ids, np.int64))[0].tobytes().decode() == text


def test_exact_merging_both_ways(vocabulary):
    rng = random.Random(2)
    words = [bytes(rng.choice(b"aeinrst the") for _ in range(rng.randrange(1, 40))) for _ in range(2000)] + [b"aaaaaaaa", b"a"]
    assert [r.tolist() for r in vocabulary.merged_together(words)] == [vocabulary.merged(w) for w in words]


def test_proposals_and_compatibility(vocabulary):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"aeinrst hgo") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    ids, word = vocabulary.propose_together(words)
    for k, w in enumerate(words):
        assert ids[word == k].tolist() == vocabulary.propose(w)
    tokens = {i: t for t, i in vocabulary.ids.items()}
    some = rng.sample(sorted(tokens), 400)
    a, b = np.array([rng.choice(some) for _ in range(3000)]), np.array([rng.choice(some) for _ in range(3000)])
    want = [vocabulary.merged(tokens[x] + tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert vocabulary.compatible(a, b).tolist() == want and 0 < sum(want) < 3000


def test_decoding_odd_ids(vocabulary, library):
    assert vocabulary.decode(np.array([-1, 10 ** 6, 50256], np.int64))[0].tobytes() == b"<|endoftext|>"


def test_operator(spark, library):
    docs = with_clashes(odd_documents(spark), "ids", "decoded", "token")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(rows) == docs.count()
    assert sorted(map(str, rows)) == sorted(map(str, bpe.encode(docs, PATH, decoded="decoded").collect()))
    for r in rows:
        assert r.decoded == (r.text or "") and r.token == "own"
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
    nothing = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 65])], "k long, ids array<int>")
    assert sorted((r.k, r.decoded) for r in bpe.decode(nothing, PATH).collect()) == [(1, ""), (2, ""), (3, "ab")]


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(empty_documents(spark), PATH), PATH).count() == 0


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
