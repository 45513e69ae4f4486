"""Numbers in compressed binary columns, so that a task's n-grams travel in few rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

from planarium.llm._text import U64, release, utf8


def packed(x: np.ndarray, kind: str) -> bytes:
    """Numbers as byte planes, compressed: most have few significant bytes."""
    x = np.ascontiguousarray(x, dtype=kind)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def ascending(x: np.ndarray) -> bytes:
    """Hashes by their differences, which are small in sorted runs."""
    return packed(np.diff(x, prepend=U64(0)), "<u8")


def from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=U64)


def bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of equal ranges of the hash space among sorted keys: range r has keys[out[r]:out[r + 1]]."""
    edges = np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=U64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Answers of a range (range, block, words, n): the counts over all blocks of each block's own words."""
    words = [from_ascending(x) for x in rows["words"]]
    u, inverse = np.unique(np.concatenate(words), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate([unpacked(x, "<u4") for x in rows["n"]]), minlength=len(u)).astype(np.int64)
    own = np.split(n[inverse], np.cumsum([len(w) for w in words])[:-1])
    release()
    return pd.DataFrame({"range": key[0], "block": rows["block"], "n": [packed(x, "<i8") for x in own]})


def pack_strings(words: pa.Array) -> bytes:
    """Strings as their lengths and their bytes, both compressed."""
    buf, offsets = utf8(words)
    lengths, text = packed(np.diff(offsets), "<u4"), zstandard.ZstdCompressor(level=1).compress(buf.tobytes())
    return len(lengths).to_bytes(8, "little") + lengths + text


def unpack_strings(data: bytes) -> pa.Array:
    at = 8 + int.from_bytes(data[:8], "little")
    lengths = unpacked(data[8:at], "<u4").astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.ZstdDecompressor().decompress(data[at:]))])
