"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A text's bytes, A-Z lower-cased, are read once; the hash of any stretch is a difference of prefix sums of table[byte] * base**position
(modulo 2**64), made independent of the place by the inverse power. That holds for stretches of LONGEST bytes at most: longer ones can be made to share such
a hash (as the Thue-Morse word of 1024 letters and its complement do), so they are hashed by blake2b one by one. Two different words, or two shingles,
share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
#: Bytes of the longest stretch that is hashed by sums.
LONGEST = 512
#: Bytes worked on at a time, about; a longer text is taken alone.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scramble of 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the base and of its inverse, made as far as they were asked for."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            def grown(step: int) -> np.ndarray:
                steps = np.full(n, step, dtype=np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)

            cls.up, cls.down = grown(BASE), grown(_INVERSE)
        return cls.up[:n], cls.down[:n]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, in order, and the index of its text."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = _BLANK[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = _Powers.upto(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[_LOWER[raw]] * up[:-1], out=sums[1:])
    hashes = long_stretches(_LOWER[raw], sums, down, starts, ends)
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1] if texts else np.zeros(0, dtype=np.int64)
    return hashes, np.searchsorted(first, starts, side="right") - 1


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A text with fewer words has one shingle of all of them; one without words has none.
    """
    for start, end in chunks(texts):
        hashes, owner = word_hashes(texts[start:end])
        bounds = np.searchsorted(owner, np.arange(end - start + 1))
        windows = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for k in range(width):
            windows += hashes[k : k + len(windows)] * U64(pow(BASE, 2 * k + 3, 1 << 64))
        windows = mix(windows)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            elif b > a:
                few = sum(int(h) * pow(BASE, 2 * k + 3, 1 << 64) for k, h in enumerate(hashes[a:b])) + int(b - a)
                yield mix(np.array([few % (1 << 64)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def byte_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums by which ``stretches`` hashes any stretch of raw bytes, and the powers that go with them."""
    up, down = _Powers.upto(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[raw] * up[:-1], out=sums[1:])
    return sums, down


def stretches(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * down[start])


def long_stretches(raw: np.ndarray, sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As stretches, for stretches of raw bytes of any length."""
    hashes = stretches(sums, down, start, end)
    for i in np.flatnonzero(end - start > LONGEST):
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes
