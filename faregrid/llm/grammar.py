"""Token ids in files: Re-Pair grammars with random access.

Documents are encoded in ascending order of their id, an end id after each, and cut into shards
of consecutive documents. In each shard frequent pairs of ids are replaced by new symbols, again
and again, until no pair is frequent. A shard keeps the rules, the length
that each symbol expands to, the remaining sequence and the documents' lengths, so that any range
of ids is found by lengths alone and only the symbols that touch it are expanded.

A shard is one binary value (little-endian; layout in `pack`) in a Parquet file, so Spark writes
and commits the files on any file system and a lost task leaves nothing behind.

Cases: a null or empty text has the end id alone; documents without id come first; documents of
the same id follow each other in the order of a hash of their texts; a document longer than a shard is a
shard of its own; columns are taken by name and further ones, whatever they are called, are not read; an
empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from faregrid.llm import common
from faregrid.llm.bpe import byte_letters, read_vocabulary
from faregrid.llm.words import Words, span_hashes

MAGIC = b"RPR1"
HEAD = struct.Struct("<4sIQQQQ")
SHARD_IDS = 1 << 20
#: Bytes of chunks and their ids that a worker remembers; beyond that it starts anew.
REMEMBERED = 96 << 20
#: A pair has to occur so often, without overlaps, to become a rule.
LEAST_COUNT = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Marks of ASCII that are neither part of a special token nor of a short form as in "it's": behind a
#: letter or digit, a run of them at the end of a chunk is a word of its own.
_MARK = np.zeros(256, bool)
_MARK[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
_LETTER_OR_DIGIT = np.zeros(256, bool)
_LETTER_OR_DIGIT[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
#: The second bytes of letters from U+00C0 to U+00FF, whose first one is C3.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
#: Chunks of these bytes alone are one word that normalising leaves as it is, so the library's model may be
#: asked directly: a to z, and the small letters of two bytes from U+00DF to U+00FF.
_SIMPLE = _SECOND.copy()
_SIMPLE[0x80:0x9F] = False
_SIMPLE[[*range(ord("a"), ord("z") + 1), 0xC3]] = True


# Ids of texts

class Chunks:
    """Different chunks, numbered, with their ids: bytes and ids each in one array, found by a table of hashes."""

    def __init__(self, bits: int = 16):
        self.hashes, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.text, self.ids = np.empty(1 << 20, np.uint8), np.empty(1 << 18, np.uint32)
        # Where each chunk's text and ids begin; the next one's begin is its end.
        self.text_at, self.ids_at, self.n = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), 0

    def size(self) -> int:
        """Bytes that are in use."""
        return int(self.text_at[self.n] + 4 * self.ids_at[self.n]) + 28 * self.n

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the chunk with each hash, -1 if there is none."""
        found = np.full(len(hashes), -1, np.int32)
        left, mask = np.arange(len(hashes)), len(self.hashes) - 1
        slot = hashes.astype(np.int64) & mask
        while len(left):
            number = self.numbers[slot]
            same = (number >= 0) & (self.hashes[slot] == hashes[left])
            found[left[same]] = number[same]
            on = (number >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & mask
        return found

    def add(self, hashes: np.ndarray, texts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Chunks that are not there yet, of different hashes; `ids` has those of all in a row, `sizes` how many each has."""
        n = self.n + len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        for name, lengths, flat in (("text", lengths, np.frombuffer(b"".join(texts), np.uint8)), ("ids", sizes, ids)):
            at = _grown(getattr(self, f"{name}_at"), n + 1)
            at[self.n + 1:n + 1] = at[self.n] + np.cumsum(lengths)
            own = _grown(getattr(self, name), int(at[n]))
            own[at[self.n]:at[n]] = flat
            setattr(self, f"{name}_at", at)
            setattr(self, name, own)
        numbers = np.arange(self.n, n, dtype=np.int32)
        self.n = n
        if 2 * n > len(self.hashes):
            used = self.numbers >= 0
            hashes, numbers = np.concatenate((self.hashes[used], hashes)), np.concatenate((self.numbers[used], numbers))
            size = 1 << (4 * n).bit_length()
            self.hashes, self.numbers = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        mask = len(self.hashes) - 1
        slot = hashes.astype(np.int64) & mask
        while len(slot):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = numbers[free]
            won = free & (self.numbers[slot] == numbers)
            self.hashes[slot[won]] = hashes[won]
            hashes, numbers, slot = hashes[~won], numbers[~won], (slot[~won] + 1) & mask

    def differ(self, numbers: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which spans, whose bytes are `flat` in a row, are not the chunk of their number: equal hashes decide nothing."""
        other = self.text_at[numbers + 1] - self.text_at[numbers] != lengths
        if other.any():
            flat, lengths = flat[np.repeat(~other, lengths)], np.where(other, 0, lengths)
        wrong = np.flatnonzero(flat != self.text[_spans(self.text_at[numbers], lengths)])
        if len(wrong):
            other[np.searchsorted(np.cumsum(lengths), wrong, "right")] = True
        return other

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these chunks in a row, and where each chunk's end."""
        lengths = self.ids_at[numbers + 1] - self.ids_at[numbers]
        return self.ids[_spans(self.ids_at[numbers], lengths)], np.cumsum(lengths)


def _grown(array_: np.ndarray, n: int) -> np.ndarray:
    """The array, or a larger one with its values, that has room for `n`."""
    return array_ if n <= len(array_) else np.concatenate((array_, np.empty(max(n, 2 * len(array_)) - len(array_), array_.dtype)))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of all spans in a row."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out


def _cut(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) like those of `words`, with the marks at the end of a word as a word of their own."""
    data, starts, ends = words.data, words.starts, words.ends
    ended = np.flatnonzero(_MARK[data[ends - 1]])
    if not len(ended):
        return starts, ends, words.first
    at, left = ends[ended], np.arange(len(ended))
    for _ in range(8):
        at[left] -= 1
        left = left[at[left] > starts[ended[left]]]
        left = left[_MARK[data[at[left] - 1]]]
    if len(left):
        # Some runs of marks are longer.
        solid = np.concatenate(([-1], np.flatnonzero(~_MARK[data])))
        at[left] = solid[np.searchsorted(solid, at[left]) - 1] + 1
    ended, at = ended[at > starts[ended]], at[at > starts[ended]]
    last = data[at - 1]
    cut = _LETTER_OR_DIGIT[last] | (_SECOND[last] & (data[np.maximum(at - 2, 0)] == 0xC3))
    ended, at = ended[cut], at[cut]
    return np.insert(starts, ended + 1, at), np.insert(ends, ended, at), words.first + np.searchsorted(ended, words.first)


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each different chunk between white space once.

    Fits vocabularies whose words never reach over white space or from a letter or digit to a mark, where
    ids of a text are the ids of its chunks, and that ignore case. Marks at the end of a chunk are a chunk of their own. Chunks
    of ASCII letters are shared in either case. Others reach the library as they are: it composes
    letters and marks before it lowers them, and finds special tokens, which begin with "<|", in
    their own case only.
    """

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: The same model for words that need no normalising, with a blank between them.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known = Chunks()
        self.letters = np.zeros(256, "<u4")
        for letter, byte in byte_letters().items():
            self.letters[byte] = ord(letter)
        self.letters[ord(" ")] = ord(" ")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        if self.known.size() > REMEMBERED:
            self.known = Chunks()
        words = Words(texts)
        starts, ends, data = words.starts, words.ends, _LOWER[words.data]
        # Chunks with other letters, or that may be special tokens, keep their case.
        odd = words.data >= 128
        odd[:-1] |= (words.data[:-1] == ord("<")) & (words.data[1:] == ord("|"))
        keeps = np.zeros(len(starts), bool)
        keeps[np.searchsorted(ends, np.flatnonzero(odd & ~words.space), "right")] = True
        odd = np.flatnonzero(keeps)
        own = _spans(starts[odd], (ends - starts)[odd])
        data[own] = words.data[own]

        starts, ends, first_of_text = _cut(words)
        hashes = span_hashes(data, starts, ends)
        numbers = self.known.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            first = new[np.unique(hashes[new], return_index=True)[1]]
            raw = data.tobytes()
            with common.uncollected():
                self._learn([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            numbers[new] = self.known.find(hashes[new])
        ids, upto = self.known.ids_of(numbers)
        upto = np.concatenate(([0], upto))[first_of_text]
        out = [ids[a:b].tobytes() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        differ = np.flatnonzero(self.known.differ(numbers, data[~words.space], ends - starts))
        for k in np.unique(np.searchsorted(first_of_text, differ, "right") - 1).tolist():
            # Another chunk has the hash of one of this text's: it is encoded without the table.
            own = slice(first_of_text[k], first_of_text[k + 1])
            out[k] = self._encoded([data[a:b].tobytes() for a, b in zip(starts[own], ends[own])])[0].tobytes()
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        """Puts different chunks, whose hashes differ and are not there, into the table."""
        self.known.add(_hashed(chunks), chunks, *self._encoded(chunks))

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and how many each has. Only chunks in small letters, or not ASCII, come here."""
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begins = np.cumsum(lengths) - lengths
        simple = np.logical_and.reduceat(_SIMPLE[flat], begins)
        parts = [np.flatnonzero(simple), np.flatnonzero(~simple)]
        found = [step([chunks[k] for k in part.tolist()]) for step, part in zip((self._letters_alone, self._normalised), parts)]
        sizes = np.empty(len(chunks), np.int64)
        for part, (_, n) in zip(parts, found):
            sizes[part] = n
        begins = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.uint32)
        for part, (own, n) in zip(parts, found):
            ids[_spans(begins[part], n)] = own
        return ids, sizes

    def _letters_alone(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Like `_encoded`, of chunks that are one word each and the same when normalised."""
        text = self.letters[np.frombuffer(b" ".join(chunks), np.uint8)].tobytes().decode("utf-32-le")
        upto = np.concatenate(([0], np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1))).tolist()
        ids, sizes = [], []
        for i in range(0, len(chunks), 128):
            j = min(i + 128, len(chunks))
            found = self.plain.encode(text[upto[i]:upto[j] - 1], add_special_tokens=False)
            ids += found.ids
            sizes.append(np.bincount(found.word_ids, minlength=j - i))
        return np.array(ids, np.uint32), np.concatenate([np.empty(0, np.int64), *sizes])

    def _normalised(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Like `_encoded`, by the whole tokenizer."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(chunks), 256):
            words = [c.decode() for c in chunks[i:i + 256]]
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            begins = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            ends = np.cumsum([len(w) + 1 for w in words])
            sizes.append(np.diff(np.searchsorted(begins, ends), prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)


def _hashed(chunks: list[bytes]) -> np.ndarray:
    return Words([b"\n".join(chunks)]).hashes()


@lru_cache(maxsize=2)
def encoder(file: str) -> ChunkEncoder:
    return ChunkEncoder(file)


# Grammars

def _numbered(first: np.ndarray, second: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct pairs with `least` places as first << 32 | second, each place's pair among them, -1 for a rarer one).

    Pair and place share a number where they fit, as sorting numbers is much faster than sorting places.
    """
    n = len(first)
    width, room = int(second.max(initial=0)) + 1, max(n, 1).bit_length()
    codes = first.astype(np.int64)
    if (int(first.max(initial=0)) + 1) * width << room < 1 << 63:
        codes *= width
        codes += second
        codes <<= room
        codes |= np.arange(n)
        codes.sort()
        order = codes & ((1 << room) - 1)
        codes >>= room
    else:
        width = 1 << 32
        codes = (codes << 32) | second
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
    new = np.ones(n, bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    begins = np.flatnonzero(new)
    counts = np.diff(begins, append=n)
    if least > 1:
        kept = counts >= least
        order, begins, counts = order[np.repeat(kept, counts)], begins[kept], counts[kept]
    place = np.full(n, -1, np.int32)
    place[order] = np.repeat(np.arange(len(begins), dtype=np.int32), counts)
    codes = codes[begins]
    return (codes // width << 32) | codes % width, place


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first new symbol, the rules' left and right symbols, the remaining sequence).

    Each round counts the pairs exactly, in a run of one symbol every other place, and replaces all
    that are more frequent than their neighbours (of equal ones, the one with the higher number).
    So the most frequent pair is always replaced, and at the end none has LEAST_COUNT places. Rounds
    leave out places whose pair was too rare, until no other is left; then all are counted again, as
    a rule used once more can make a rare pair frequent.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    # Every rule saves three places at least, so there are fewer rules than ids.
    seq = ids.astype(np.int32 if base + len(ids) < 1 << 31 else np.int64)
    # Some places of a pair may be taken in a later round, by the same rule.
    rules, symbols = {}, base
    # Places whose pair may be frequent.
    open_ = np.ones(max(len(seq) - 1, 0), bool)
    while True:
        at = np.flatnonzero(open_)
        whole = len(at) == len(open_)
        distinct, pair = _numbered(seq[at], seq[at + 1], LEAST_COUNT)
        # Pairs with too few places, overlaps included, are out at once.
        frequent = np.flatnonzero(pair >= 0)
        at, pair = at[frequent], pair[frequent]
        # Of a run of places with one symbol twice, every other one counts.
        counts_here = np.ones(len(at), bool)
        twice = np.flatnonzero((distinct >> 32 == distinct & 0xFFFFFFFF)[pair])
        if len(twice):
            order = np.arange(len(twice))
            begins = np.concatenate(([True], (np.diff(at[twice]) > 1) | (np.diff(pair[twice]) != 0)))
            counts_here[twice] = (order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0
            count = np.bincount(pair[counts_here], minlength=len(distinct))
            frequent = count[pair] >= LEAST_COUNT
            at, pair, counts_here = at[frequent], pair[frequent], counts_here[frequent]
        else:
            count = np.bincount(pair, minlength=len(distinct))
        open_[:] = False
        open_[at] = True
        if not len(at):
            if whole:
                break
            open_[:] = True
            continue
        weight = (count * len(distinct) + np.arange(len(distinct)))[pair]
        best = counts_here.copy()
        close = np.diff(at) == 1
        heavier = weight[1:] > weight[:-1]
        best[1:] &= ~close | heavier | (pair[1:] == pair[:-1])
        best[:-1] &= ~(close & heavier)
        used = np.bincount(pair[best], minlength=len(distinct))
        made = np.flatnonzero(used >= LEAST_COUNT)
        best &= (used >= LEAST_COUNT)[pair]
        hits = at[best]
        name = np.zeros(len(distinct), np.int64)
        codes = distinct[made].tolist()
        new = [code for code in codes if code not in rules]
        rules.update(zip(new, range(symbols, symbols + len(new))))
        symbols += len(new)
        name[made] = [rules[code] for code in codes]
        seq[hits] = name[pair[best]]
        stays = np.ones(len(seq), bool)
        stays[hits + 1] = False
        # The places of a new symbol and before it hold new pairs.
        open_[hits] = True
        open_[hits[hits > 0] - 1] = True
        before = hits[hits > 1]
        before = before[~stays[before - 1]]
        open_[before - 2] = True
        open_ = np.concatenate((open_, [False]))
        last = hits[hits + 2 == len(seq)]
        open_[last] = False
        seq, open_ = seq[stays], open_[stays][:-1]
    codes = np.array(list(rules), np.int64)
    return base, codes >> 32, codes & 0xFFFFFFFF, seq.astype(np.int64)


class Grammar:
    """Symbols, what they expand to, and a sequence of them."""

    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, seq: np.ndarray):
        self.base, self.left, self.right, self.seq = base, left, right, seq
        self.lengths = np.concatenate((np.ones(base, np.int64), lengths))
        self.ends = np.cumsum(self.lengths[seq])

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from `begin` to `end`: only the symbols that touch them are expanded."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        end = total if end is None else min(end, total)
        if begin >= end:
            return np.empty(0, np.int64)
        a, b = np.searchsorted(self.ends, begin, "right"), np.searchsorted(self.ends, end - 1, "right")
        skipped = int(self.ends[a - 1]) if a else 0
        return self._expand(self.seq[a:b + 1])[begin - skipped:end - skipped]

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids of symbols; where there are many, each different one is expanded once."""
        if len(seq) <= len(self.lengths):
            return self._opened(seq)
        used = np.flatnonzero(np.bincount(seq))
        begins = np.zeros(len(self.lengths), np.int64)
        begins[used] = np.cumsum(self.lengths[used]) - self.lengths[used]
        return self._opened(used)[_spans(begins[seq], self.lengths[seq])]

    def _opened(self, seq: np.ndarray) -> np.ndarray:
        """The ids of symbols, from the top of their rules down; each pass touches open symbols only."""
        lengths = self.lengths[seq]
        at = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.int64)
        while len(seq):
            done = seq < self.base
            out[at[done]] = seq[done]
            at, rule = at[~done], seq[~done] - self.base
            left, right = self.left[rule], self.right[rule]
            at = np.concatenate((at, at + self.lengths[left]))
            seq = np.concatenate((left, right))
        return out


def expansion_lengths(base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for; rules refer to earlier ones only."""
    out = np.ones(len(left), np.int64)
    depth_left = 0
    while depth_left < len(left):
        # All rules whose parts are known by now: those before the first that uses a later one.
        ready = np.flatnonzero(np.maximum(left, right)[depth_left:] - base >= depth_left)
        stop = depth_left + int(ready[0]) if len(ready) else len(left)
        span = slice(depth_left, stop)
        for part in (left, right):
            own = np.where(part[span] < base, 1, out[np.maximum(part[span] - base, 0)])
            out[span] = own if part is left else out[span] + own
        depth_left = stop
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32)


def pack(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """One shard: head (magic, widths, first new symbol, number of rules, symbols, documents),
    then left, right, rule lengths (32 bit), sequence, document lengths (64 bit)."""
    base, left, right, seq = compress(ids)
    both, seq = _narrow(np.concatenate((left, right))), _narrow(seq)
    head = HEAD.pack(MAGIC, both.itemsize | seq.itemsize << 8, base, len(left), len(seq), len(sizes))
    lengths = expansion_lengths(base, left, right).astype("<u4")
    return b"".join((head, both.tobytes(), lengths.tobytes(), seq.tobytes(), sizes.astype("<i8").tobytes()))


def unpack(blob: bytes) -> tuple[Grammar, np.ndarray]:
    magic, widths, base, n_rules, n_symbols, n_docs = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at, parts = HEAD.size, []
    for kind, n in ((f"<u{widths & 255}", 2 * n_rules), ("<u4", n_rules), (f"<u{widths >> 8}", n_symbols), ("<i8", n_docs)):
        parts.append(np.frombuffer(blob, kind, n, at).astype(np.int64))
        at += parts[-1].size * int(kind[2:])
    both, lengths, seq, sizes = parts
    return Grammar(base, both[:n_rules], both[n_rules:], lengths, seq), sizes


# Files

def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all documents below `path`: a row per shard (part, shard, first offsets
    inside it by document, ids of its documents, the packed grammar), parts and shards ascending."""
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = np.uint32(end_id).tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        names, rows, size = [], [], 0
        words = encoder(file.value)

        def filled() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(rows), np.uint32)
            sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([pack(ids, sizes)], pa.binary())],
                names=["part", "shard", "n_ids", "doc_ids", "data"])

        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in common.text_slices(batch.column(1)):
                for row in words.encode(texts):
                    if rows and size + len(row) // 4 >= shard_ids:
                        yield filled()
                        names, rows, size, shard = [], [], 0, shard + 1
                    names.append(ids[at])
                    rows.append(row + end)
                    size += len(row) // 4 + 1
                    at += 1
        if rows:
            yield filled()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    # The hash lets documents of one id, or without any, be dealt to several ranges.
    ordered = ordered.repartitionByRange(n, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    common.map_arrow(ordered.select("doc_id", "text"), step, "part int, shard int, n_ids long, doc_ids array<long>, data binary").write.parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files.

    Starts are summed up over parts first, then inside a part.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select("part", "shard", "n_ids").join(parts, "part").select(
        "part", "shard", (F.col("base") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).alias("begin"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, names, blob in zip(*(batch.column(k) for k in range(4))):
                grammar, sizes = unpack(blob.as_py())
                ids = memoryview(grammar.ids().astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[4 * (b - n):4 * b]) for n, b in zip(sizes.tolist(), ends.tolist())]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()),
                     names.values, pa.array(ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                    names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = common.map_arrow(files.select("part", "shard", "doc_ids", "data"), step,
                            "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(begins, ["part", "shard"]).select(
        "doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
