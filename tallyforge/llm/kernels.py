"""Vectorised text kernels over Arrow string buffers.

Every kernel sees a *chunk*: some whole documents as one byte buffer plus their offsets.  A null text is an empty
document.  Chunks are cut at document boundaries near ``CHUNK_BYTES``, so memory is bounded by that or by the longest
single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: digits, a-z and all non-ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes of ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False

_powers = {"pow": np.ones(1, _U), "inv": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (mod 2**64) of the hash base and of its inverse."""
    if len(_powers["pow"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("pow", _BASE), ("inv", _INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["pow"][:n], _powers["inv"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values give unrelated hashes."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole documents."""
    raw, ends = buffers(column)
    row, n = 0, len(ends) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, to, raw[ends[row] : ends[to]], ends[row : to + 1] - ends[row]
        row = to


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that don't cross documents, and the number of runs before each document."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = member[inner]
    last = np.empty(n, bool)
    last[:-1] = member[:-1] & (~member[1:] | first[1:])
    last[-1] = member[-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes, equal hash, wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def window_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of each n consecutive word hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, _U)
    out = np.full(size, salt, _U)
    for j in range(n):
        out = out * _U(_BASE) + words[j : j + size]
    return mix(out)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, then starts, ends and per-document counts-before of their words."""
    low = LOWER[data]
    return low, *runs(WORD[low], offsets)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each run, from the numbers of runs before each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
