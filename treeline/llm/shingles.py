"""Words and word shingles of byte columns as 64-bit hashes, in numpy.

Words are runs of bytes other than space, \\t, \\n, \\v, \\f, \\r; A-Z count as a-z.  A word's hash is a polynomial in
its bytes, modulo 2**64, finished by a bijective mixer; a shingle's combines those of its words in order.
"""

from __future__ import annotations

import numpy as np

from treeline.llm.arrays import mix

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to count - 1."""
    if len(_powers[0]) < count:
        size = 1 << (count - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:count], _powers[1][:count]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and the place after its end, in order; no word spans two rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data), bool)
    starts_of_rows = offsets[:-1][np.diff(offsets) > 0]
    edge[1:] = inside[1:] & ~inside[:-1]
    edge[starts_of_rows] = inside[starts_of_rows]
    over = np.zeros(len(data), bool)
    over[:-1] = inside[:-1] & ~inside[1:]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    over[lasts] = inside[lasts]
    return np.flatnonzero(edge), np.flatnonzero(over) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order; for each row, the place of its first word (and, last, the count of words)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begins, ends = bounds or word_bounds(data, offsets)
    up, down = powers(len(data) + 1)
    total = np.cumsum((_LOWER[data] + np.uint64(1)) * up[: len(data)])
    before = np.where(begins > 0, total[begins - 1], 0).astype(np.uint64)
    hashes = mix((total[ends - 1] - before) * down[begins] + (ends - begins).astype(np.uint64))
    return hashes, np.searchsorted(begins, offsets).astype(np.int64)


def word_endings(data: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], buckets: int) -> np.ndarray:
    """A bucket (of a power of two) for the last three bytes of each word."""
    begins, ends = bounds
    code = np.zeros(len(ends), np.uint64)
    for k in range(1, 4):
        code = (code << np.uint64(8)) | np.where(ends - k >= begins, _LOWER[data[np.maximum(ends - k, 0)]], 0).astype(np.uint64)
    return (mix(code + np.uint64(1)) >> np.uint64(65 - buckets.bit_length())).astype(np.int32)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle of ``width`` words; a row of fewer words (one at least) has one shingle, the whole."""
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    out = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        out = out * BASE + words[k : k + len(out)]
    place = np.arange(len(out))
    whole = first[1:][rows[: len(out)]] - place >= width
    hashes, owner = mix(out[whole]), rows[: len(out)][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(width):
            there = count[short] > k
            own[there] = own[there] * BASE + words[first[:-1][short][there] + k]
        hashes = np.concatenate([hashes, mix(own ^ count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted by hash, one after the other; where each row's begin and end."""
    hashes, owner = shingle_hashes(*word_hashes(data, offsets), width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(offsets))).astype(np.int64)
