"""Counting quotient filters over packed n-grams: compact, lossless, merged in sorted order.

An n-gram of word ids is packed into 64-bit lanes. An invertible permutation spreads the first lane,
whose upper bits are the quotient; the lower bits and the other lanes are the remainder, kept whole,
so a counter stands for one n-gram and no other. A filter is sorted by quotient and remainder: a
file of it stores how many remainders each quotient has, the remainders in as few bytes as they
need, and the counts in one byte each, larger ones apart. Filters cut at the same quotients are
merged run by run.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from faregrid.llm.common import mixed

_HEAD = struct.Struct("<QQQ")
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LANE_FACTORS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xA0761D6478BD642F)
#: A count of this or more is stored apart.
_LARGE = 255


@dataclass(frozen=True)
class Packing:
    """How `k` word ids of `bits` bits (at most 31) share lanes, and where quotients are cut.

    `range_bits` upper bits of the first lane name a range, whose filters form a file;
    `slot_bits` further ones complete the quotient.
    """

    k: int
    bits: int
    range_bits: int = 0
    slots: int = 10

    @property
    def lane_bits(self) -> list[int]:
        per_lane = 63 // self.bits
        return [self.bits * min(per_lane, self.k - a) for a in range(0, self.k, per_lane)]

    @property
    def slot_bits(self) -> int:
        return min(self.slots, self.lane_bits[0] - self.shared_bits)

    @property
    def shared_bits(self) -> int:
        return min(self.range_bits, self.lane_bits[0])

    def pack(self, ids: np.ndarray) -> list[np.ndarray]:
        """The lanes of every window of `k` ids."""
        n, per_lane, lanes = len(ids) - self.k + 1, 63 // self.bits, []
        ids = ids.astype(np.uint64)
        for a in range(0, self.k, per_lane):
            lane = np.zeros(max(n, 0), np.uint64)
            for j in range(a, min(a + per_lane, self.k)):
                lane |= ids[j:j + max(n, 0)] << np.uint64(self.bits * (j - a))
            lanes.append(lane)
        return lanes

    def unpack(self, lanes: list[np.ndarray]) -> np.ndarray:
        """The ids, a row per n-gram."""
        per_lane, mask = 63 // self.bits, np.uint64((1 << self.bits) - 1)
        columns = [(lanes[j // per_lane] >> np.uint64(self.bits * (j % per_lane))) & mask for j in range(self.k)]
        return np.stack(columns, 1).astype(np.int32)

    def permute(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        first, p = lanes[0] ^ self._others(lanes), self.lane_bits[0]
        mask, half = np.uint64((1 << p) - 1), np.uint64((p + 1) // 2)
        for factor in _FACTORS:
            first = (first * np.uint64(factor)) & mask
            first ^= first >> half
        return [first, *lanes[1:]]

    def restore(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        """The inverse of `permute`."""
        first, p = lanes[0], self.lane_bits[0]
        mask, half = np.uint64((1 << p) - 1), np.uint64((p + 1) // 2)
        for factor in reversed(_FACTORS):
            # The shift is half the width, so it undoes itself.
            first = first ^ (first >> half)
            first = (first * np.uint64(pow(factor, -1, 1 << 64))) & mask
        return [first ^ self._others(lanes), *lanes[1:]]

    def _others(self, lanes: list[np.ndarray]) -> np.ndarray:
        """What the other lanes add to the first one, so that it spreads by all words."""
        out = np.zeros(len(lanes[0]), np.uint64)
        for lane, factor in zip(lanes[1:], _LANE_FACTORS):
            out ^= mixed(lane * np.uint64(factor))
        return out & np.uint64((1 << self.lane_bits[0]) - 1)


def marks(lanes: list[np.ndarray]) -> np.ndarray:
    """A 62-bit hash of packed n-grams."""
    total = np.zeros(len(lanes[0]), np.uint64)
    for lane, factor in zip(lanes, _LANE_FACTORS):
        total += mixed(lane + np.uint64(1)) * np.uint64(factor)
    return (mixed(total) >> np.uint64(2)).astype(np.int64)


class Filter:
    """Permuted n-grams in ascending order, each once, and their counts."""

    def __init__(self, packing: Packing, lanes: list[np.ndarray], counts: np.ndarray):
        self.packing, self.lanes, self.counts = packing, lanes, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, packing: Packing, lanes: list[np.ndarray]) -> Filter:
        """Counts n-grams as `pack` gives them."""
        lanes = packing.permute(lanes)
        return cls._sorted(packing, lanes, np.ones(len(lanes[0]), np.int64))

    @classmethod
    def merge(cls, filters: list[Filter]) -> Filter:
        if len(filters) == 1:
            return filters[0]
        lanes = [np.concatenate(x) for x in zip(*(f.lanes for f in filters))]
        return cls._sorted(filters[0].packing, lanes, np.concatenate([f.counts for f in filters]))

    @classmethod
    def _sorted(cls, packing: Packing, lanes: list[np.ndarray], counts: np.ndarray) -> Filter:
        # Stable sorting takes runs that are in order as they are.
        order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
        lanes = [lane[order] for lane in lanes]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for lane in lanes:
            new[1:] |= lane[1:] != lane[:-1]
        begins = np.flatnonzero(new)
        counts = np.add.reduceat(counts[order], begins) if len(begins) else counts
        return cls(packing, [lane[begins] for lane in lanes], counts)

    def at_least(self, n: int) -> Filter:
        good = self.counts >= n
        return Filter(self.packing, [lane[good] for lane in self.lanes], self.counts[good])

    def grams(self) -> list[np.ndarray]:
        """The packed n-grams, as they came in."""
        return self.packing.restore(self.lanes)

    def pieces(self) -> Iterator[tuple[int, bytes]]:
        """(range, file) of every range that holds something."""
        shift = np.uint64(self.packing.lane_bits[0] - self.packing.shared_bits)
        name = (self.lanes[0] >> shift).astype(np.int64)
        begins = np.flatnonzero(np.diff(name, prepend=-1))
        for a, b in zip(begins, np.append(begins[1:], len(name))):
            yield int(name[a]), self._file(a, b)

    def _file(self, a: int, b: int) -> bytes:
        own, bits = self.packing, self.packing.lane_bits
        rest = bits[0] - own.shared_bits - own.slot_bits
        first = self.lanes[0][a:b]
        slot = (first >> np.uint64(rest)) & np.uint64((1 << own.slot_bits) - 1)
        runs = np.bincount(slot.astype(np.int64), minlength=1 << own.slot_bits).astype("<u4")
        parts = [_short(first & np.uint64((1 << rest) - 1), rest)]
        parts += [_short(lane[a:b], n) for lane, n in zip(self.lanes[1:], bits[1:])]
        counts = self.counts[a:b]
        large = np.flatnonzero(counts >= _LARGE)
        return b"".join((_HEAD.pack(b - a, len(large), len(runs)), runs.tobytes(), *parts,
                         np.minimum(counts, _LARGE).astype(np.uint8).tobytes(),
                         large.astype("<u4").tobytes(), counts[large].astype("<i8").tobytes()))

    @classmethod
    def read(cls, packing: Packing, name: int, file: bytes) -> Filter:
        n, n_large, n_runs = _HEAD.unpack_from(file)
        at, bits = _HEAD.size, packing.lane_bits
        runs = np.frombuffer(file, "<u4", n_runs, at)
        at += 4 * n_runs
        rest = bits[0] - packing.shared_bits - packing.slot_bits
        lanes = []
        for width in (rest, *bits[1:]):
            lanes.append(_long(file, at, n, width))
            at += n * ((width + 7) // 8)
        lanes[0] |= np.repeat(np.arange(n_runs, dtype=np.uint64), runs) << np.uint64(rest)
        lanes[0] |= np.uint64(name << (bits[0] - packing.shared_bits))
        counts = np.frombuffer(file, np.uint8, n, at).astype(np.int64)
        at += n
        counts[np.frombuffer(file, "<u4", n_large, at)] = np.frombuffer(file, "<i8", n_large, at + 4 * n_large)
        return cls(packing, lanes, counts)


def _short(values: np.ndarray, bits: int) -> bytes:
    """Numbers in as many bytes as `bits` need."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8].tobytes()


def _long(file: bytes, at: int, n: int, bits: int) -> np.ndarray:
    width = (bits + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(file, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").reshape(n).astype(np.uint64)
