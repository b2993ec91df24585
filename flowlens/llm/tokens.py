"""Words of whole Arrow batches as numpy arrays: borders, 64-bit hashes and shingle hashes, without a Python loop per word.

A batch is worked through in slices of about ``SLICE`` bytes (a longer text is a slice of its own), so memory follows the
longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII white space.
NOT_SPACE = ~SPACE
#: ASCII letters and digits, and every byte of a longer character.
ALNUM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_low:_high] = True
#: The same without digits.
LETTER = ALNUM.copy()
LETTER[0x30:0x3A] = False
#: Maps A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            grown = _powers[k]
            _powers[k] = np.concatenate([grown, grown * np.uint64(pow(base, len(grown), 1 << 64))])
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: ``start``/``end`` byte borders in ``data``, ``doc`` (text number) and ``hash`` per word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = word[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.concatenate([[False], inside])[:n] & ~first[:n]
        after = np.concatenate([inside[1:], [False]])[:n] & ~first[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        #: Number of words before each text, and in all.
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.count = np.diff(self.first)
        self._lower = lower
        self._sums: np.ndarray | None = None

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _power_table(len(self.data) + 1)
        if self._sums is None:
            data = LOWER[self.data] if self._lower else self.data
            self._sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * up[: len(data)], out=self._sums[1:])
        return mixed((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self._spans(self.start, self.end)
        return self._hash

    def prefix_hash(self, length: int) -> np.ndarray:
        """Hash of the first ``length`` bytes of each word (of the word itself if it is not longer)."""
        return self._spans(self.start, np.minimum(self.end, self.start + length))

    def text_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each text's sequence of words."""
        up, down = _power_table(len(self.hash) + 1)
        out = []
        for scale in (_STEP[0], _STEP[1]):
            sums = np.zeros(len(self.hash) + 1, np.uint64)
            np.cumsum(mixed(self.hash * scale) * up[: len(self.hash)], out=sums[1:])
            a, b = self.first[:-1], self.first[1:]
            out.append(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
        return out[0], out[1]

    def shingles(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``k`` consecutive words of one text, and the number of the first word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.full(n, seed, np.uint64)
        for j in range(k):
            total += self.hash[j: j + n] * _STEP[(j + 7 * seed) % 64]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1: k - 1 + n])
        return mixed(total[at]), at


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``low, high, bytes, offsets`` of runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        yield low, high, data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]
        low = high


def words_of(texts: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """``low, high, Words`` of runs of texts."""
    for low, high, data, offsets in slices(texts):
        yield low, high, Words(data, offsets, word, lower)
