"""Words of many texts at once, found and hashed without a loop over words."""

from __future__ import annotations

import numpy as np

from faregrid.llm.common import mixed

#: Word separators: space and the control characters 9 to 13, all single bytes in UTF-8.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd, so that its powers can be divided out again modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: differences of prefix sums of a polynomial."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts])


class Words:
    """The words of a list of texts.

    `starts`/`ends` are byte positions in `data`, the texts joined by line ends; `first` has
    the index of each text's first word, and the number of words last.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        space = IS_SPACE[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.space = space

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have their flag set."""
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[self.offsets])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.starts, self.ends)
