"""64-bit hashes of words, word prefixes and shingles over whole batches of texts with numpy.

A word's hash is a polynomial over its bytes, read from running sums, so a batch needs a fixed number of array
operations however many words it has. Words are maximal runs of bytes other than ASCII white space, which for UTF-8
are the matches of ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WHITE = b"\t\n\x0b\x0c\r "
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_space = np.zeros(256, bool)
_space[list(WHITE)] = True
_value = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64)
_value[_space] = 0

BLOCK = 1 << 20  # bytes that are hashed at a time; words across them are kept whole


def _power(n: int) -> list[np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out


_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Running sums over bytes, from which the hash of any run of them is read."""

    def __init__(self, data: np.ndarray):
        if len(data) > BLOCK:
            powers, self._inverse = _power(len(data) + 1)  # a single word of that length; not kept
        else:
            if not _powers:
                _powers.extend(_power(BLOCK + 1))
            powers, self._inverse = _powers
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_value[data] * powers[: len(data)], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])


class Words:
    """The words of a batch of byte strings: ``start``, ``end`` in the joined bytes, and ``first[i]:first[i + 1]`` of text i.

    Sums are taken over blocks that end between words, so their memory is that of a block, or of the longest word.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(joined, np.uint8)
        gap = _space[self.bytes]
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        self.start = np.flatnonzero(before & ~gap)
        self.end = np.flatnonzero(gap & ~before)
        ends = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, ends)
        self._kept: list[tuple[int, int, Sums]] = []

    def _parts(self) -> Iterator[tuple[int, int, Sums]]:
        """(from, to, sums) of the blocks; those of a batch of common size are kept."""
        if self._kept:
            yield from self._kept
            return
        a = 0
        while a < len(self.start):
            low = int(self.start[a])
            a = max(int(np.searchsorted(self.end, low + BLOCK, "right")), a + 1)
            high = int(self.end[a - 1])
            part = (low, high, Sums(self.bytes[low:high]))
            if len(self.bytes) <= 4 * BLOCK:
                self._kept.append(part)
            yield part

    def _of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges in order, each in a word."""
        out = np.empty(len(start), np.uint64)
        for low, high, sums in self._parts():
            a, b = np.searchsorted(start, (low, high))
            out[a:b] = sums.hashes(start[a:b] - low, end[a:b] - low)
        return out

    def hashes(self) -> np.ndarray:
        return self._of(self.start, self.end)

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of more than ``k`` bytes, and hashes of their first ``k``."""
        at = np.flatnonzero(self.end - self.start > k)
        s = self.start[at]
        return at, self._of(s, s + k)


_LANES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours in ``h``; none if ``h`` is shorter."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += h[k : k + n] * _LANES[k]
    return mix(out)


def shingles(words: Words, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of a shorter text its whole sequence; of no word none."""
    h = words.hashes()
    every = windows(h, width)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(windows(h[a:b], n) if n else np.empty(0, np.uint64))
    return out
