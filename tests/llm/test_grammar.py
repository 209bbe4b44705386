"""Token files: exact round trips, random access, and ids as the library gives them."""

import random
import zlib
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import empty_documents, odd_documents, with_clashes
from pyspark.sql import functions as F
from test_bpe import texts
from tokenizers import Tokenizer

from faregrid.llm import common, grammar
from faregrid.llm.bpe import read_vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_of_chunks(library):
    every = texts() + ["É́ÉΣσς İ K ß.", "end.,!? (end).", "<|startoftext|>a <|endoftext|>.", "a.b,c!"]
    found = grammar.ChunkEncoder(read_vocabulary(PATH)).encode([t.encode() for t in every])
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert [np.frombuffer(f, np.uint32).tolist() for f in found] == want


def test_case_of_special_tokens_and_marked_letters(library):
    every = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b <|EndOfText|>.", "<|STARTOFTEXT|>A", "A<|endoftext|>B", "<| ENDOFTEXT |>",
             "J\u030c", "H\u0331 x", "T\u0308.", "W\u030aW\u030A", "j\u030c h\u0331 t\u0308 w\u030a", "ÀB É́ A\u0300B\u0301 ΑΣ ΑΣ. İI"]
    every += [" ".join(every), "\n".join(t.lower() for t in every), "<|endoftext|> J\u030c Plain WORDS"]
    found = grammar.ChunkEncoder(read_vocabulary(PATH)).encode([t.encode() for t in every])
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert [np.frombuffer(f, np.uint32).tolist() for f in found] == want


def test_words_with_marks_behind_them_are_learned_once(library):
    """Each word and each run of marks is one chunk, however they meet; only those with other letters or bytes are normalised."""
    every = ["Tree TREE! tree? tree.. tree$$$ été été! été.. été$$$ tree&&& été*** 12! 12.."]
    encoder = grammar.ChunkEncoder(read_vocabulary(PATH))
    seen, real = [], encoder._normalised
    encoder._normalised = lambda chunks: seen.extend(chunks) or real(chunks)
    found = encoder.encode([t.encode() for t in every])
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert [np.frombuffer(f, np.uint32).tolist() for f in found] == want
    assert encoder.known.n == len({"tree", "été", "12", "!", "?", "..", "$$$", "&&&", "***"})
    assert not any(c.isalpha() or "é" in c.decode() for c in seen)


def test_marks_behind_every_kind_of_letter(library):
    marks = [chr(b) for b in range(33, 127) if not chr(b).isalnum()]
    marks += ["'s", "'s!", "!'s", "'", "!'", "..<", "<|", "|>", "!\u0301", "=\u0338", "--!?", "!x", "é!", "<|endoftext|>!", "_a_", "...."]
    cores = ["", "a", "Z", "7", "é", "É", "ß", "À", "×", "÷", "中", "😀", "a\u0300", "½", "ª", "\u00a0", "ñandú", "a.b", "<|endoftext|>", "¿", "aÃ"]
    every = [core + mark for core in cores for mark in marks] + [" ".join(core + mark for mark in marks) for core in cores] + ["", "!", "-" * 3000, "a" + "-" * 3000]
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    encoder = grammar.ChunkEncoder(read_vocabulary(PATH))
    for _ in range(2):
        assert [np.frombuffer(f, np.uint32).tolist() for f in encoder.encode([t.encode() for t in every])] == want


def test_equal_hashes_do_not_mix_chunks(library, monkeypatch):
    """With hashes of four values nearly all chunks collide; ids are right all the same."""
    real = grammar.span_hashes
    monkeypatch.setattr(grammar, "span_hashes", lambda *a: real(*a) % np.uint64(4))
    monkeypatch.setattr(grammar, "_hashed", lambda chunks: grammar.Words([b"\n".join(chunks)]).hashes() % np.uint64(4))
    monkeypatch.setattr(grammar.Words, "hashes", lambda self: real(self.data, self.starts, self.ends) % np.uint64(4))
    every = texts() + ["one two. two! three 3.", "", "two"]
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    encoder = grammar.ChunkEncoder(read_vocabulary(PATH))
    for _ in range(2):
        assert [np.frombuffer(f, np.uint32).tolist() for f in encoder.encode([t.encode() for t in every])] == want


def test_the_table_grows_and_starts_anew(library, monkeypatch):
    rng = random.Random(8)
    every = [" ".join("".join(rng.choice("abcdeé.") for _ in range(rng.randrange(1, 9))) for _ in range(300)) for _ in range(60)]
    want = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    for limit in (1 << 30, 5000):
        monkeypatch.setattr(grammar, "REMEMBERED", limit)
        encoder = grammar.ChunkEncoder(read_vocabulary(PATH))
        encoder.known = grammar.Chunks(bits=4)
        found = [x for k in range(0, 60, 7) for x in encoder.encode([t.encode() for t in every[k:k + 7]])]
        assert [np.frombuffer(f, np.uint32).tolist() for f in found] == want
    assert encoder.known.size() < 100_000


def test_pairs_are_numbered_alike_in_either_way():
    rng = np.random.default_rng(1)
    for top in (5, 1000, 1 << 31):
        first, second = rng.integers(0, top, (2, 3000))
        distinct, place = grammar._numbered(first, second)
        assert (distinct[place] == (first << 32) | second).all() and (np.diff(distinct) > 0).all()
    assert [len(x) for x in grammar._numbered(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]


def test_repeated_symbols_are_expanded_once():
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 40, 30_000)
    g, _ = grammar.unpack(grammar.pack(ids, np.array([len(ids)])))
    opened, real = [], g._opened
    g._opened = lambda seq: opened.append(len(seq)) or real(seq)
    assert g.ids().tolist() == ids.tolist() and g.ids(7000, 29_000).tolist() == ids[7000:29_000].tolist()
    assert len(g.seq) > len(g.lengths) >= opened[0] and g.ids(70, 75).tolist() == ids[70:75].tolist()


def test_rare_pairs_get_no_number():
    rng = np.random.default_rng(3)
    for top in (30, 1 << 31):
        first, second = rng.integers(0, top, (2, 200))[:, rng.integers(0, 200, 3000)] if top > 30 else rng.integers(0, top, (2, 3000))
        every, place = grammar._numbered(first, second)
        distinct, kept = grammar._numbered(first, second, 4)
        often = np.bincount(place) >= 4
        assert distinct.tolist() == every[often].tolist() and ((kept >= 0) == often[place]).all()
        assert (distinct[kept[kept >= 0]] == every[place[kept >= 0]]).all()
    assert [len(x) for x in grammar._numbered(np.empty(0, np.int64), np.empty(0, np.int64), 4)] == [0, 0]


@pytest.mark.parametrize("ids", [
    [], [5], [5, 5], [7] * 1001, [1, 2] * 600, list(range(3000)), [0, 1, 2, 3] * 50 + [9] * 7 + [1, 2] * 9,
    [random.Random(1).randrange(6) for _ in range(5000)], [70_000, 2 ** 31 - 1] * 40])
def test_round_trip(ids):
    ids = np.array(ids, np.uint32)
    if len(ids) and ids.max() > 1 << 20:
        ids = ids % 200_000
    blob = grammar.pack(ids, np.array([len(ids)]))
    g, sizes = grammar.unpack(blob)
    assert g.ids().tolist() == ids.tolist() and sizes.tolist() == [len(ids)]
    rng = random.Random(2)
    for _ in range(60):
        a = rng.randrange(len(ids) + 1)
        b = rng.randrange(a, len(ids) + 2)
        assert g.ids(a, b).tolist() == ids[a:b].tolist()


def test_frequent_pairs_become_rules():
    ids = np.array(([1, 2, 3, 4] * 3 + [9]) * 200, np.uint32)
    base, left, right, seq = grammar.compress(ids)
    assert base == 10 and len(left) >= 3 and len(seq) < len(ids) / 4
    assert (np.maximum(left, right) < base + np.arange(len(left))).all()


def places(seq):
    """How often each pair occurs; in a run of one symbol every other place counts."""
    out, skip = Counter(), False
    for k, pair in enumerate(zip(seq, seq[1:])):
        skip = not skip and k > 0 and pair[0] == pair[1] == seq[k - 1]
        out[pair] += not skip
    return out


@pytest.mark.parametrize("n, kinds", [(20_000, 40), (20_000, 3), (300_000, 60_000), (3000, 1)])
def test_no_frequent_pair_is_left(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = np.minimum(rng.zipf(1.3, n), kinds).astype(np.uint32)
    base, left, right, seq = grammar.compress(ids)
    assert max(places(seq.tolist()).values(), default=0) < grammar.LEAST_COUNT
    assert len(set(zip(left.tolist(), right.tolist()))) == len(left)
    g = grammar.Grammar(base, left, right, grammar.expansion_lengths(base, left, right), seq)
    assert (g.ids() == ids).all()


def test_colliding_pairs_are_counted():
    codes = np.random.default_rng(3).integers(0, 1 << 62, 400_000)
    codes = np.concatenate((codes, codes))
    distinct, place = grammar._numbered(codes >> 32, codes & 0xFFFFFFFF)
    assert len(np.unique(distinct)) == len(distinct) and (distinct[place] == codes).all()


def expected(docs, library):
    start = 0
    for r in docs.orderBy("doc_id", F.xxhash64("text"), "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        yield r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_files(spark, library, tmp_path, shard_ids):
    docs = odd_documents(spark)
    path = str(tmp_path / "ids")
    grammar.write_ids(docs, path, PATH, shard_ids=shard_ids)
    files = spark.read.parquet(path)
    assert files.count() > (20 if shard_ids == 50 else 0)
    assert sorted(map(tuple, grammar.read_ids(files).collect()), key=str) == sorted(expected(docs, library), key=str)


def test_clashing_columns(spark, tmp_path):
    docs = odd_documents(spark, 30)
    found = []
    for k, df in enumerate((docs, with_clashes(docs, "part", "shard", "n_ids", "doc_ids", "data", "text_hash", "start", "n_tokens"))):
        grammar.write_ids(df, str(tmp_path / str(k)), PATH)
        found.append(sorted(map(tuple, grammar.read_ids(spark.read.parquet(str(tmp_path / str(k)))).collect()), key=str))
    assert found[0] == found[1]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    grammar.write_ids(empty_documents(spark), path, PATH)
    assert grammar.read_ids(spark.read.parquet(path)).count() == 0


def test_texts_are_encoded_in_slices_of_a_megabyte(spark, monkeypatch):
    """Arrays of eight bytes for each byte of a slice are what a worker holds most of."""
    seen, steps, context = [], [], MagicMock()

    class Recorder:
        def encode(self, texts):
            seen.append(sum(map(len, texts)))
            return [b""] * len(texts)
    context.get.return_value.partitionId.return_value = 0
    monkeypatch.setattr(common, "map_arrow", lambda df, step, schema: steps.append(step) or MagicMock())
    monkeypatch.setattr(grammar, "encoder", lambda file: Recorder())
    monkeypatch.setattr(grammar, "TaskContext", context)
    grammar.write_ids(empty_documents(spark), "", PATH)
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["x " * 200_000] * 8)], names=["doc_id", "text"])
    made, = steps[0](iter([batch]))
    assert made.column(2)[0].as_py() == 8 and sum(seen) == 8 * 400_000 and max(seen) <= 1 << 20
