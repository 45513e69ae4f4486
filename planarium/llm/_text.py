"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch inside a Spark task: texts arrive as
one contiguous UTF-8 buffer, and words, shingles and windows become 64-bit
hashes through prefix sums of a polynomial over that buffer.  No function
keeps state that grows with the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = U64(0xD6E8FEB86659FD93)

#: Bytes of text handled at once by one task (a longer text is handled alone).
SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POWERS = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i below n, kept at the largest size asked for."""
    have = _POWERS.get("n", 0)
    if have < n:
        n = max(n, 1 << 16)
        for key, b in (("p", _BASE), ("q", _BASE_INV)):
            x = np.full(n, b, dtype=U64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
        _POWERS["n"] = n
    return _POWERS["p"], _POWERS["q"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] identifying buf[i:j] once it is moved by B^-i."""
    p, _ = _powers(len(buf) + 1)
    c = np.empty(len(buf) + 1, dtype=U64)
    c[0] = 0
    np.cumsum(_TABLE[buf] * p[: len(buf)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each buf[start:end]."""
    _, q = _powers(len(c))
    return mix((c[ends] - c[starts]) * q[starts])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n+1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give memory that is free again back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of `column`."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < len(sizes):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def words(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n+1 entries)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    inside = ~separator[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased) and the first word of each text."""
    buf, offsets = utf8(column)
    buf = LOWER[buf]
    starts, ends, first = words(buf, offsets)
    return span_hash(prefix_hash(buf), starts, ends), first


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of each run of `width` values; the last width-1 entries don't exist."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(width):
        out *= _STEP
        out += h[j : j + n]
    return mix(out)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than `width` the whole sequence is the only one."""
    h, first = word_hashes(column)
    all_windows = window_hashes(h, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(all_windows[a : b - width + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(window_hashes(h[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out
