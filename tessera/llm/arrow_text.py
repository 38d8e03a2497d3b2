"""Word and shingle hashing straight from Arrow string buffers.

The functions work on many documents at once as one flat byte array, so that no
Python string is made per word.  Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, with A-Z lower-cased; a shingle is five consecutive words.
Hashes have 64 bits; documents with one to four words have one shingle, the
whole word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at once (a longer document makes its own chunk).
CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, CHUNK_BYTES + 64)
        for key, base in (("p", _BASE), ("q", _INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def ranges(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes together, or of one document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def substring_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for each pair of bounds."""
    p, q = powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, U64)
    total[0] = 0
    np.cumsum(_VALUE[raw] * p[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the first word of each document (with a last bound)."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, np.int8)
    if len(raw):
        edge[1:-1] = inside[1:].view(np.int8) - inside[:-1].view(np.int8)
        edge[0] = inside[0]
        edge[-1] = -int(inside[-1])
        at = offsets[1:-1]
        at = np.unique(at[(at > 0) & (at < len(raw))])
        at = at[inside[at] & inside[at - 1]]  # words never join across documents
        start = np.sort(np.concatenate((np.flatnonzero(edge == 1), at)))
        end = np.sort(np.concatenate((np.flatnonzero(edge == -1), at)))
    else:
        start = end = np.zeros(0, np.int64)
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return substring_hashes(_LOWER[raw], start, end)


def combine(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * U64(0x9FB21C651E98DF25)
    for k in range(1, width):
        out = (out ^ (out >> U64(29))) * U64(0xD1342543DE82EF95) + h[k : k + n]
    return mix(out)


def shingle_lists(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each document its shingle hashes in text order, with repeats."""
    start, end, first = words(raw, offsets)
    h = word_hashes(raw, start, end)
    s = combine(h, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield s[a : b - width + 1]
        elif b > a:
            yield combine(h[a:b], b - a) ^ U64(b - a)
        else:
            yield s[:0]


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes of its whole text."""
    raw, offsets = flat(column)
    for a, b in ranges(offsets):
        lo = offsets[a]
        for s in shingle_lists(raw[lo : offsets[b]], offsets[a : b + 1] - lo, width):
            yield np.unique(s)
