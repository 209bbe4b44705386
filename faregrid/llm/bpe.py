"""Byte-level BPE: speculate and verify.

A text is cut into units at white space. Units that a worker has met before are looked up;
each new one is cut into words, for which a greedy longest match proposes tokens. Such a
sequence is what merging gives exactly if every adjacent pair of its tokens is compatible,
that is, if merging the two tokens' bytes gives the same two tokens again. All pairs are tested
together in numpy; only words with a failing pair are merged step by step.

Decoding gathers the bytes of all ids at once.

Cases: a null or empty text has no ids, and null or no ids decode to an empty text; the special
tokens' strings in a text become their ids; ids outside the vocabulary decode to nothing; an
input column named like the result is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from faregrid.llm import common

#: Units that a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
#: Unicode's white space, and the word pattern of byte-level vocabularies.
SPACE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")
#: Letters and digits up to here are the same in all versions of Unicode in use.
STABLE = "԰"
NEVER = np.iinfo(np.int64).max
#: Failing words of more bytes are merged one by one, with a heap.
SHORT = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Rank and result of the merge of two ids, looked up for whole arrays (open addressing)."""

    def __init__(self, size: int, merges: dict[tuple[int, int], tuple[int, int]]):
        self.size = size
        self.bits = max(8, (4 * len(merges)).bit_length())
        codes = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.made = np.full(len(codes), NEVER), np.full(len(codes), -1, np.int64)
        keys = np.array([a * size + b for a, b in merges], np.int64)
        for code, slot, (rank, made) in zip(keys.tolist(), self._slot(keys).tolist(), merges.values()):
            while codes[slot] >= 0:
                slot = (slot + 1) % len(codes)
            codes[slot], self.ranks[slot], self.made[slot] = code, rank, made
        self.codes = codes

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; an empty one if it cannot be merged."""
        codes = a * self.size + b
        slot = self._slot(codes)
        rest = np.flatnonzero((self.codes[slot] != codes) & (self.codes[slot] >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.codes) - 1)
            there = self.codes[slot[rest]]
            rest = rest[(there != codes[rest]) & (there >= 0)]
        return slot

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.ranks[self.find(a, b)]


class Vocabulary:
    """The tables of a byte-level BPE file."""

    def __init__(self, file: str):
        spec = json.loads(file)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                    if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.longest = max(map(len, self.ids))
        size = 1 + max([*self.ids.values(), *self.special.values()])
        pieces = [b""] * size
        for token, i in self.ids.items():
            pieces[i] = token
        #: Of a token: when it was merged (-1: a byte) and from what.
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.sound = True
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (self.ids[bytes(letters[c] for c in part)] for part in (
                merge if isinstance(merge, list) else merge.split(" ")))
            made = self.ids[pieces[a] + pieces[b]]
            self.sound &= bool(self.rank[made] < 0 and max(self.rank[a], self.rank[b]) < rank)
            self.merges.setdefault((a, b), (rank, made))
            self.rank[made], self.left[made], self.right[made] = rank, a, b
        self.size = size
        self.pairs = PairTable(size, self.merges)
        nodes = {b"": 0}
        for token in self.ids:
            for n in range(1, len(token) + 1):
                nodes.setdefault(token[:n], len(nodes))
        self.accepts = np.full(len(nodes), -1, np.int64)
        for token, i in self.ids.items():
            self.accepts[nodes[token]] = i
        self.tree = PairTable(256, {(nodes[t[:-1]], t[-1]): (0, n) for t, n in nodes.items() if t})
        self.bytes_of = [self.ids[bytes([b])] for b in range(256)]
        for content, i in self.special.items():
            pieces[i] = content.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.letter_bytes = letters

    # Proposals and their check

    def propose_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at each place of many short words: ids in order, and each one's word.

        All words walk down the tree of tokens side by side; one that can go no further takes
        the last token it passed and starts anew behind it.
        """
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.concatenate(([0], ends[:-1]))
        word, node = np.arange(len(words)), np.zeros(len(words), np.int64)
        token, back = np.full(len(words), -1), at.copy()
        found, owner = [], []
        while len(word):
            slot = self.tree.find(node, data[at])
            child = np.where(at < ends, self.tree.made[slot], -1)
            goes = child >= 0
            at = at + goes
            node = np.where(goes, child, 0)
            own = self.accepts[node]
            passed = goes & (own >= 0)
            token, back = np.where(passed, own, token), np.where(passed, at, back)
            stuck = np.flatnonzero(~goes)
            if len(stuck):
                found.append(token[stuck])
                owner.append(word[stuck])
                at[stuck] = back[stuck]
                live = goes | (back < ends)
                if not live.all():
                    word, node, token, back, at, ends = (x[live] for x in (word, node, token, back, at, ends))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        owners = np.concatenate(owner)
        order = np.argsort(owners, kind="stable")
        return np.concatenate(found)[order], owners[order]

    def propose(self, word: bytes) -> list[int]:
        """The longest token at each place, from the start."""
        out, at, end, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < end:
            stop = min(end, at + longest)
            while (found := ids.get(word[at:stop])) is None:
                stop -= 1
            out.append(found)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a and b, for all pairs, ends in a, b.

        Both tokens' merges are undone, latest first (of the same merge, the right one, as
        merging goes from left to right). If the tokens that then meet at the border could be
        merged before the merge just undone, merging would have crossed the border.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), NEVER)
        while len(live):
            crossed = self.pairs.rank(a, b) < limit
            ok[live[crossed]] = False
            undo_left = self.rank[a] > self.rank[b]
            latest = np.where(undo_left, self.rank[a], self.rank[b])
            # At the same rank, a merge across the border precedes the right token's own.
            limit = latest + ~undo_left
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            go_on = ~crossed & (latest >= 0)
            live, a, b, limit = live[go_on], a[go_on], b[go_on], limit[go_on]
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the earliest possible merge first, from left to right."""
        ids = [self.bytes_of[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges, end = self.merges, len(ids)
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (p := (ids[i], ids[k])) in merges:
                    heapq.heappush(heap, (merges[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in merges:
                heapq.heappush(heap, (merges[p][0], h, *p))
        return [i for i in ids if i >= 0]

    def merged_together(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many short words, one merge of each per round."""
        flat = np.array(self.bytes_of)[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        found = [None] * len(words)
        while len(flat):
            slot = self.pairs.find(flat[:-1], flat[1:])
            rank = np.append(np.where(word[1:] == word[:-1], self.pairs.ranks[slot], NEVER), NEVER)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            ready = least == NEVER
            for k, a, b in zip(word[first[ready]].tolist(), first[ready].tolist(),
                               np.append(first[1:], len(flat))[ready].tolist()):
                found[k] = flat[a:b]
            sizes = np.diff(np.append(first, len(flat)))
            hit = (rank == np.repeat(least, sizes)) & (rank < NEVER)
            # Of hits in a row (the same token again and again) every other one, from the left.
            at = np.arange(len(flat))
            begin = hit & ~np.concatenate(([False], hit[:-1]))
            hit &= (at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 0
            flat = flat.copy()
            flat[hit] = self.pairs.made[slot[np.flatnonzero(hit)]]
            stays = ~np.concatenate(([False], hit[:-1])) & np.repeat(~ready, sizes)
            flat, word = flat[stays], word[stays]
        return found

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as 32-bit integers."""
        fits = np.fromiter(map(len, words), np.int64, len(words)) <= SHORT
        ids, word = self.propose_together([w for w in words if len(w) <= SHORT])
        word = np.flatnonzero(fits)[word]
        for k in np.flatnonzero(~fits).tolist():
            row = self.propose(words[k])
            at = np.searchsorted(word, k)
            ids, word = np.insert(ids, at, row), np.insert(word, at, [k] * len(row))
        counts = np.bincount(word, minlength=len(words))
        inside = word[1:] == word[:-1]
        if self.sound:
            failing = ~self.compatible(ids[:-1][inside], ids[1:][inside])
            again = np.unique(word[1:][inside][failing]).tolist()
        else:
            again = range(len(words))
        raw, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(counts)).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        short = [k for k in again if len(words[k]) <= SHORT]
        for k, row in zip(short, self.merged_together([words[k] for k in short])):
            out[k] = row.astype(np.int32).tobytes()
        for k in again:
            if len(words[k]) > SHORT:
                out[k] = np.array(self.merged(words[k]), np.int32).tobytes()
        return out

    # Texts

    def _words(self, unit: str) -> list[bytes]:
        if unit.isascii() or max(unit) < STABLE:
            if unit.isalpha() or unit[0] == " " and unit[1:].isalpha():
                return [unit.encode()]
            return [w.encode() for w in WORD.findall(unit)]
        letters = self.letter_bytes
        return [bytes(letters[c] for c in w) for w, _ in self.cutter.pre_tokenize_str(unit)]

    def learn(self, units: set[str]) -> None:
        known = self.known
        # A letter and a final mark never share a word: the part before it is learned instead.
        ended = [u for u in units if u[-1] in ".,!?:;" and u[-2:-1].isalpha() and u[-2] < STABLE]
        units = list((units.difference(ended) | {u[:-1] for u in ended} | {u[-1] for u in ended}).difference(known))
        cut = [self._words(u) for u in units]
        rows = iter(self.encode_words([w for words in cut for w in words]))
        for unit, words in zip(units, cut):
            known[unit] = next(rows) if len(words) == 1 else b"".join([next(rows) for _ in words])
        for unit in ended:
            known[unit] = known[unit[:-1]] + known[unit[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        plain = [self._parts(text) for text in texts]
        units = [[UNIT.findall(part) if isinstance(part, str) else part for part in parts] for parts in plain]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {u for parts in units for part in parts if isinstance(part, list) for u in part}.difference(self.known)
        if new:
            with common.uncollected():
                self.learn(new)
        known = self.known
        return [b"".join(b"".join([known[u] for u in part]) if isinstance(part, list) else np.int32(part).tobytes()
                         for part in parts) for parts in units]

    def _parts(self, text: str) -> list[str | int]:
        if self.splitter is None or not any(s in text for s in self.special):
            return [text]
        return [self.special.get(part, part) for part in self.splitter.split(text)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and how many each id gave."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        lengths = np.append(self.lengths, 0)[ids]
        ends = np.cumsum(lengths)
        place = np.repeat(np.append(self.offsets, 0)[ids] - (ends - lengths), lengths)
        return self.data[place + np.arange(len(place))], lengths

    def texts(self, column: pa.ListArray) -> pa.Array:
        """The texts of lists of ids."""
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        data, lengths = self.decode(column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())


@lru_cache(maxsize=2)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` with the column `ids` (array of int): the tokens of `text`; and, if a name is given,
    the column `decoded`: the text that these ids stand for, decoded in the same pass.

    The vocabulary file (a few MB) is read by the driver and sent to the workers.
    """
    added = [ids] if decoded is None else [ids, decoded]
    kept = common.kept_columns(docs, added)
    at = kept.index("text")
    file = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file.value)
        for batch in batches:
            done = 0
            for texts in common.text_slices(batch.column(at)):
                rows = words.encode([t.decode() for t in texts])
                ends = np.cumsum([0] + [len(r) // 4 for r in rows], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                new = [column] if decoded is None else [column, words.texts(column)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(done, len(texts)) for c in batch.columns), *new], names=[*kept, *added])
                done += len(texts)

    kinds = [T.ArrayType(T.IntegerType()), T.StringType()]
    return common.map_arrow(docs.select(*map(common.quoted, kept)), step,
                            common.extended(docs, kept, list(zip(added, kinds))))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded` with the column `text` that its `ids` stand for (bytes that are no UTF-8 become
    replacement characters)."""
    kept = common.kept_columns(encoded, [text])
    at = kept.index(ids)
    file = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(file.value)
        for batch in batches:
            column = batch.column(at)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            # Pieces of a million ids; a longer row is one piece.
            piece = np.cumsum(sizes) // (1 << 20)
            for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(piece)) + 1) if len(sizes) else ():
                own = [c.slice(int(rows[0]), len(rows)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, words.texts(own[at])], names=[*kept, text])

    return common.map_arrow(encoded.select(*map(common.quoted, kept)), step,
                            common.extended(encoded, kept, [(text, T.StringType())]))
