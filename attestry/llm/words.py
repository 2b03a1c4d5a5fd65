"""Cuts a batch of texts into words or units and hashes every one, all in numpy.

Hashes are 64 bits: a random value for each byte, weighted by the powers of an odd base, summed over
the word by differences of one running sum and then mixed with the word's length. Two different
words share a hash with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes hashed at once: one running sum of so many 64-bit values is held.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK + (1 << 16))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of a batch in order: bytes data[start:end], text number doc, hash; n texts of size bytes each, text k starting at base[k]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    base: np.ndarray
    size: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of the words' values by text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[np.searchsorted(self.doc, np.arange(1, len(self.size) + 1))] - total[np.searchsorted(self.doc, np.arange(len(self.size)))]


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    base = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(parts) else size
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), base, size


def finish(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.ndarray, size: np.ndarray) -> Words:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers(BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * powers(INVERSE, len(data) + 1)[start]
    h = mix(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(data, start, end, np.searchsorted(base, start, "right") - 1, h, base, size)


def words(parts: list[bytes], lower: bool = False, space: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes outside ``space`` (which holds the newline); ``lower``: A-Z become a-z first."""
    data, base, size = joined(parts)
    if lower:
        data = LOWER[data]
    gap = space[data]
    before = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    return finish(data, start, end, base, size)


def units(parts: list[bytes]) -> Words:
    """Each text cut before every space that follows a character that is surely not white space."""
    data, base, size = joined(parts)
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), data])[: len(data)] for k in (1, 2, 3))
    cut = (data == 32) & (one > 32) & ~((one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
    cut[base] = size > 0
    start = np.flatnonzero(cut)
    doc = np.searchsorted(base, start, "right") - 1
    end = np.minimum(np.concatenate([start[1:], [len(data)]]), (base + size)[doc]) if len(start) else start
    return finish(data, start, end, base, size)
