"""Hashed word shingles of whole texts, computed on the bytes of an Arrow column at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240607)
#: ASCII lower case (A-Z only) and the white space of the word pattern [^\x20\x09-\x0D]+.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _BYTE[_LOWER]  # a letter's case makes no difference
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_MIX = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, list[np.ndarray]] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _POWERS.setdefault(base, [np.ones(1, np.uint64)])
    while len(known[0]) < n:
        known[0] = np.concatenate((known[0], known[0] * np.uint64(pow(base, len(known[0]), 1 << 64))))
    return known[0][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts (null: empty)."""
    column = pa.compute.fill_null(column, "").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and the number of its text."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)  # positions where a text begins, and the end
    first[ends] = True
    begin = ~space
    begin[1:] &= space[:-1] | first[1:-1]
    stop = ~space
    stop[:-1] &= space[1:] | first[1:-1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers(_P, len(raw)), dtype=np.uint64)))
    value = (sums[stop] - sums[begin]) * powers(_P_INVERSE, len(raw))[begin]
    return mix(value + (stop - begin).astype(np.uint64) * _MIX[0]), np.searchsorted(ends, begin, "right") - 1


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; a text of fewer words has its
    whole sequence as one; no words give an empty set."""
    raw, ends = column_bytes(column)
    words, text = word_hashes(raw, ends)
    bounds = np.searchsorted(text, np.arange(len(ends)))
    out = []
    if len(words) >= k:
        rolled = words[:len(words) - k + 1] * _MIX[1]
        for j in range(1, k):
            rolled = rolled + words[j:len(words) - k + 1 + j] * _MIX[1 + j]
        rolled = mix(rolled)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _MIX[8:8 + b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
