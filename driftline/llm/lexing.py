"""Vectorised word handling on Arrow string buffers: no Python object is made for a word.

Separators are ASCII, so word bounds can be found on UTF-8 bytes. Every function works on one chunk:
`data` (uint8), `offs` (int64, document bounds, offs[0] == 0).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes handled at once; a single longer document makes a longer chunk.
CHUNK_BYTES = 1 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 256

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None


def trimmed(run):
    """run, a function over Arrow batches, that gives memory back to the system when a task ends: a worker outlives
    its tasks, and what it keeps counts against its executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
ALNUM_ANY_CASE = ALNUM.copy()
ALNUM_ANY_CASE[0x41:0x5B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SEEDS = (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
_MASKS = np.array([0, *((1 << (8 * k)) - 1 for k in range(1, 8)), (1 << 64) - 1], np.uint64)
_S29, _S32 = np.uint64(29), np.uint64(32)


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, data, offs) for runs of whole documents. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, buf = column.buffers()
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): word k is data[starts[k]:ends[k]], document d has words bounds[d]:bounds[d + 1]."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    gap = ~w
    left, right = edge[:n].copy(), edge[1:].copy()
    left[1:] |= gap[:-1]
    right[:-1] |= gap[1:]
    left &= w
    right &= w
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(starts, offs)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): the words, each followed by one space; word k is bytes[bounds[k] : bounds[k + 1] - 1]."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(bounds[-1]), 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(bounds[:-1], size) + inside] = data[np.repeat(starts, size) + inside]
    return out, bounds


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * M1
    h ^= h >> _S32
    h *= M2
    h ^= h >> _S29
    return h


def loads(data: np.ndarray) -> np.ndarray:
    """View v with v[i] = the eight bytes from i on, little-endian, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    view, size = loads(data), ends - starts
    h = _mix((view[starts] & _MASKS[np.minimum(size, 8)]) ^ SEEDS[seed] ^ (size.astype(np.uint64) << np.uint64(48)))
    rest = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    at = 8
    while len(rest):
        left = size[rest] - at
        h[rest] = _mix(h[rest] ^ (view[starts[rest] + at] & _MASKS[np.minimum(left, 8)]))
        at += 8
        rest = rest[left > 8]
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed=int(SEEDS[seed]))
    return h


_C = np.uint64(0xD6E8FEB86659FD93)
_C_INV = np.uint64(pow(int(_C), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Windows:
    """Hashes of runs of consecutive words, any length, from one prefix sum."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(_C, n), out=self.prefix[1:])
        self.back = _powers(_C_INV, n + 1)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mix((self.prefix[starts + length] - self.prefix[starts]) * self.back[starts] ^ np.uint64(length))


def window_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Word positions from which `length` words follow inside the same document."""
    n = int(bounds[-1])
    if n < length:
        return np.zeros(0, np.int64)
    ok = np.zeros(n, bool)
    ok[: n - length + 1] = True
    for end in bounds[1:-1]:
        ok[max(0, end - length + 1) : end] = False
    return np.flatnonzero(ok)


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Mask of length n, True inside any [start, stop)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, stops, -1)
    return np.cumsum(d[:n]) > 0
