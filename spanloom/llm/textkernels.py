"""Array kernels over the bytes of many texts: word hashes, shingles and their sets.

Texts come as Arrow string columns; all work is numpy over the UTF-8 bytes, in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**61, dtype=np.uint64)) * 8 + 3
_BASE_INV = pow(_BASE, -1, 2**64)
_MULT = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Letters, digits and every byte of a multi-byte character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

CHUNK = 1 << 19


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of rows with about CHUNK bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    n, wide = len(column), pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        to = min(to, n)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, index of the first word of each text and the end) of maximal runs of ``inside`` bytes, A-Z lower-cased."""
    n = len(data)
    ok = inside[data]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= ok[heads]
    starts = np.flatnonzero(first)
    per_text = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, per_text
    v = _BYTE[LOWER[data]]
    v[~ok] = 0
    v *= _power(_BASE, n)
    h = np.add.reduceat(v, starts)
    h *= _power(_BASE_INV, n)[starts]
    return mix(h), starts, per_text


def windows(h: np.ndarray, per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words and where each text's runs begin (and the end of the last); texts with fewer words have none."""
    count = np.diff(per_text)
    runs = np.maximum(count - k + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(runs)))
    if len(h) < k:
        return np.zeros(0, np.uint64), bounds
    s = h[: len(h) - k + 1] * _MULT[0]
    for j in range(1, k):
        s += h[j : len(h) - k + 1 + j] * _MULT[j]
    keep = np.ones(len(s), bool)
    for j in range(1, k):
        tail = per_text[1:] - j
        tail = tail[(tail >= per_text[:-1]) & (tail < len(s))]
        keep[tail] = False
    return mix(s[keep]), bounds


def shingle_sets(column: pa.Array, k: int, inside: np.ndarray = ~SPACE) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles; fewer words make one shingle, none an empty set."""
    for _, rows, data, offsets in chunks(column):
        h, _, per_text = words(data, offsets, inside)
        s, bounds = windows(h, per_text, k)
        for i in range(rows):
            n = per_text[i + 1] - per_text[i]
            if n >= k:
                yield np.unique(s[bounds[i] : bounds[i + 1]])
            elif n:
                own = h[per_text[i] : per_text[i + 1]]
                yield mix(np.array([(own * _MULT[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
