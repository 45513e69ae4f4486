"""Removal of repeated byte strings by a column-wise Burrows-Wheeler construction.

Every byte that lies in a `length`-byte string which also starts earlier is
removed.  The work is cut into collections small enough for a task:

1. Texts are packed into blocks, once, in a table that is bucketed by block, so
   that later steps meet them without moving them.  Each window of `length`
   bytes chooses anchors among its k-byte grams, those of least hash, so equal
   windows choose equal anchors at equal offsets.  Blocks send fingerprints of
   their anchors to ranges of the hash space and learn which occur again.
2. Around each of these anchors lies the segment of bytes that its windows can
   reach.  Equal segments are settled by their hashes: all but the earliest are
   covered.  Bytes travel only for anchors with several distinct segments.
3. Segments that share an anchor come together.  They are aligned on it, so
   the collection's transform is built column by column from the right: each
   round inserts one symbol of every segment, updates the order of all current
   suffixes by a stable sort on the new symbol, and their common prefixes by
   range minima.  Neighbours with a common prefix of `length` bytes or more are
   equal windows, and all but the earliest owner's are covered.  An anchor of
   very many occurrences is replaced by longer ones.
4. Covered intervals return to the blocks of their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.llm._pack import ascending, bounds, from_ascending, packed, summed, unpacked
from planarium.llm._store import bucketed, small_batches, written
from planarium.llm._text import U64, mix, prefix_hash, release, slices, span_hash, utf8

GRAM = 32
#: Bytes of text of a block, and those whose anchors one range of the hash space holds (about).
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
#: Segments of one collection (about; those of one anchor stay together), and occurrences beyond which an anchor is replaced.
COLLECTION = 20_000
_NONE = np.iinfo(np.uint32).max
#: A byte that UTF-8 never holds.
PAD = b"\xff"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values; one result for each start."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, x[-1], dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(rows, width)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[: n - width + 1], ahead[width - 1 : n])


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the buffer and hashes of the anchors; a text shorter than `length` has none."""
    width = length - gram + 1
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    c = prefix_hash(buf)
    n = len(buf) - gram + 1
    at = np.arange(n)
    h = span_hash(c, at, at + gram)
    v = (h >> U64(33)).astype(np.uint32)
    for back in range(1, gram):  # grams that reach into the next text
        p = offsets[1:] - back
        v[p[(p >= 0) & (p < n)]] = _NONE
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    low = _sliding(v, width, np.minimum)
    # A gram is an anchor if it is the least of some window that holds it.
    edge = np.zeros(width - 1, dtype=v.dtype)
    best = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    found = np.flatnonzero((best == v) & (v != _NONE))
    size = np.repeat(np.diff(offsets), np.diff(offsets))
    found = found[size[found] >= length]
    return found, h[found]


class Columns:
    """The transform of aligned segments, one column after the other from the right.

    order: the segments by their suffix from the current column on; common: the
    bytes that a suffix shares with the one before it.  `symbols` is the column
    of the transform: the symbol before each suffix, in order.
    """

    def __init__(self, rows: np.ndarray):
        self.rows, self.column = rows, rows.shape[1]
        self.order = np.arange(len(rows))
        self.common = np.zeros(len(rows), dtype=np.int32)

    @property
    def symbols(self) -> np.ndarray:
        return self.rows[self.order, self.column - 1] if self.column else np.zeros(len(self.rows), np.uint8)

    def insert(self) -> None:
        """Insert the next symbol of every segment; padding is shared with nothing."""
        s = self.symbols
        turn = np.argsort(s, kind="stable")
        s = s[turn]
        low = self._minima(turn)
        low[1:] = np.where((s[1:] == s[:-1]) & (s[1:] != PAD[0]), low[1:] + 1, 0)
        low[0] = 0
        self.order, self.common, self.column = self.order[turn], low, self.column - 1

    def _minima(self, turn: np.ndarray) -> np.ndarray:
        """Least common prefix between each suffix and the one that now comes before it."""
        n = len(turn)
        out = np.zeros(n, dtype=np.int32)
        a, b = turn[:-1] + 1, turn[1:] + 1  # range a..b-1 of `common`; within one symbol a < b
        ok = a < b
        a, b = a[ok], b[ok]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        got = np.empty(len(a), dtype=np.int32)
        table, width = self.common, 1
        for k in range(int(level.max()) + 1 if len(level) else 0):
            if k:
                table = np.minimum(table[: len(table) - width], table[width:])
                width *= 2
            at = np.flatnonzero(level == k)
            got[at] = np.minimum(table[a[at]], table[b[at] - width])
        out[1:][ok] = got
        return out


def covered_windows(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last covered window start of each segment (first > last: none); earlier rows own what they share."""
    n, width = rows.shape
    first, last = np.full(n, width), np.full(n, -1)
    c = Columns(rows)
    while c.column:
        c.insert()
        if c.column > width - length:
            continue
        runs = np.flatnonzero(c.common < length)
        sizes = np.diff(np.append(runs, n))
        if len(runs) == n:
            continue
        owner = np.repeat(np.minimum.reduceat(c.order, runs), sizes)
        taken = c.order[owner != c.order]
        first[taken] = c.column
        last[taken] = np.maximum(last[taken], c.column)
    return first, last


class Block:
    """Texts of a block: raw bytes, offsets, keys, and the positions of their anchors."""

    def __init__(self, row: pd.Series):
        self.raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["raw"]), np.uint8)
        sizes = unpacked(row["sizes"], "<u4").astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.doc, self.th, self.at = unpacked(row["doc"], "<i8"), unpacked(row["th"], "<i8"), np.cumsum(unpacked(row["at"], "<u4"), dtype=np.int64)

    def edges(self, at: np.ndarray, ord_: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that windows around an anchor can reach."""
        return np.maximum(self.offsets[ord_], at - (length - GRAM)), np.minimum(self.offsets[ord_ + 1], at + length)


def _blocks(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []

    def close():
        nonlocal held, seq, size
        doc, th, sizes, raw, at, keys = (np.concatenate([h[i] for h in held]) for i in range(6))
        words, n = np.unique(keys >> U64(64 - bits), return_counts=True)
        row = {"block": [part << 32 | seq], "doc": [packed(doc, "<i8")], "th": [packed(th, "<i8")], "sizes": [packed(sizes, "<u4")], "raw": [zstandard.ZstdCompressor(level=3).compress(raw.tobytes())], "at": [packed(np.diff(at, prepend=0), "<u4")], "words": [ascending(words)], "n": [packed(n, "<u4")]}
        held, seq, size = [], seq + 1, 0
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in list(row)[1:])]))

    for batch in slices(batches):
        buf, offsets = utf8(batch.column("text"))
        at, h = anchors(buf, offsets, length)
        doc, th = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "th"))
        held.append((doc, th, np.diff(offsets), buf, at + size, mix(h)))
        size += len(buf)
        if size >= BLOCK_BYTES:
            yield close()
    if held:
        yield close()


def _parts(batches: Iterator[pa.RecordBatch], ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Anchors of each block with their number, cut into ranges."""
    for batch in batches:
        for b, words, n in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "n"))):
            words, n = from_ascending(words), unpacked(n, "<u4")
            at = bounds(words << U64(64 - bits), ranges)
            rows = [(r, b, ascending(words[at[r] : at[r + 1]]), packed(n[at[r] : at[r + 1]], "<u4")) for r in np.flatnonzero(np.diff(at)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "block", "words", "n"])
    release()


def _cover_row(block: int, ord_: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
    """A row of covered intervals of a block: documents by number, bytes within them."""
    return (0, block, None, None, None, None, packed(ord_, "<u4"), packed(lo, "<u4"), packed(hi - lo, "<u4"))


#: Rows that pass between the steps. kind 0: covered intervals of block `key`; kind 1: segments in range `key` of the hash space.
_ROWS = "kind int, key long, name binary, anchor binary, doc binary, th binary, ord binary, lo binary, size binary"
_COLUMNS = [c.split()[0] for c in _ROWS.split(", ")]


def _loaded(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    load = [("name", from_ascending), ("anchor", lambda x: unpacked(x, "<u8")), ("doc", lambda x: unpacked(x, "<i8")), ("th", lambda x: unpacked(x, "<i8")), ("ord", lambda x: unpacked(x, "<u8")), ("lo", lambda x: unpacked(x, "<u4")), ("size", lambda x: unpacked(x, "<u4"))]
    return tuple(np.concatenate([f(x) for x in rows[c]]) for c, f in load)


def _occurrences(block: pd.DataFrame, answers: pd.DataFrame, length: int, ranges: int, bits: int, collection: int) -> pd.DataFrame:
    """Segments of the anchors that occur again, the earliest of each kind in its block; the others are covered.

    `name` identifies a segment and its anchor's place in it.  Anchors with
    more than `collection` occurrences go by longer ones: of the window bytes
    beside an anchor, half lie on one side, so the anchor with that many bytes
    to the left, and to the right, stand for it.
    """
    if not len(block) or not len(answers):
        return pd.DataFrame(columns=_COLUMNS)
    b, number = Block(block.iloc[0]), int(block["block"].iloc[0])
    c = prefix_hash(b.raw)
    at = b.at
    h = span_hash(c, at, at + GRAM)
    key = mix(h)
    _, inverse = np.unique(key >> U64(64 - bits), return_inverse=True)
    n = np.concatenate([unpacked(x, "<i8") for x in answers.sort_values("range")["n"]])[inverse]
    again = n > 1
    at, h, n = at[again], h[again], n[again]
    ord_ = np.searchsorted(b.offsets, at, side="right") - 1
    lo, hi = b.edges(at, ord_, length)
    name = mix(h ^ mix(span_hash(c, lo, hi) ^ U64(0x51ED27) * (at - lo).astype(U64)))
    doc, th = b.doc[ord_], b.th[ord_]
    order = np.lexsort((at, ord_, th, doc, name))
    at, h, n, ord_, lo, hi, name, doc, th = (x[order] for x in (at, h, n, ord_, lo, hi, name, doc, th))
    first = np.ones(len(name), dtype=bool)
    first[1:] = name[1:] != name[:-1]
    rest = ~first & (hi - lo >= length)
    base = b.offsets[ord_]
    rows = [_cover_row(number, ord_[rest], lo[rest] - base[rest], hi[rest] - base[rest])] if rest.any() else []
    at, h, n, ord_, lo, hi, name, doc, th, base = (x[first] for x in (at, h, n, ord_, lo, hi, name, doc, th, base))
    half = -(-(length - GRAM) // 2)
    hot = n > collection
    left, right = hot & (at - half >= base), hot & (at + GRAM + half <= b.offsets[ord_ + 1])
    keep = [(np.flatnonzero(~hot), mix(h[~hot])), (np.flatnonzero(left), mix(span_hash(c, at[left] - half, at[left] + GRAM) ^ U64(0x1EF7))), (np.flatnonzero(right), mix(span_hash(c, at[right], at[right] + GRAM + half) ^ U64(0x51DE)))]
    which, anchor = (np.concatenate([k[i] for k in keep]) for i in (0, 1))
    # A segment under two longer anchors is two entries.
    name = mix(name[which] ^ anchor)
    order = np.argsort(name)
    which, anchor, name = which[order], anchor[order], name[order]
    cut = bounds(name, ranges)
    for r in np.flatnonzero(np.diff(cut)).tolist():
        w, s = which[cut[r] : cut[r + 1]], slice(cut[r], cut[r + 1])
        place = np.full(len(w), number, dtype=np.int64).astype(U64)
        rows.append((1, r, ascending(name[s]), packed(anchor[s], "<u8"), packed(doc[w], "<i8"), packed(th[w], "<i8"), packed(place, "<u8"), packed(ord_[w], "<u4"), packed(at[w] - base[w], "<u4")))
    release()
    return pd.DataFrame(rows, columns=_COLUMNS)


def _earliest(key: tuple, rows: pd.DataFrame, length: int, ranges: int) -> pd.DataFrame:
    """Of equal segments, all but the earliest are covered; the earliest go on, by anchor (lo: document number, size: place)."""
    name, anchor, doc, th, place, ord_, pos = _loaded(rows)
    order = np.lexsort((pos, ord_, place, th, doc, name))
    name, anchor, doc, th, place, ord_, pos = (x[order] for x in (name, anchor, doc, th, place, ord_, pos))
    first = np.ones(len(name), dtype=bool)
    first[1:] = name[1:] != name[:-1]
    out = []
    by = np.argsort(place[~first], kind="stable")
    p, o, q = place[~first][by], ord_[~first][by], pos[~first][by]
    edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]])) if len(p) else []
    for a, z in zip(edges[:-1], edges[1:]):
        # The interval is cut to the text where it is applied; a segment shorter than a window has no interval there.
        out.append((2, int(p[a]), None, None, None, None, packed(o[a:z], "<u4"), packed(q[a:z], "<u4"), None))
    by = np.argsort(anchor[first], kind="stable")
    anchor, doc, th, place, ord_, pos = (x[first][by] for x in (anchor, doc, th, place, ord_, pos))
    cut = bounds(anchor, ranges)
    for r in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[r], cut[r + 1])
        out.append((1, r, ascending(anchor[s]), packed(anchor[s], "<u8"), packed(doc[s], "<i8"), packed(th[s], "<i8"), packed(place[s], "<u8"), packed(ord_[s], "<u4"), packed(pos[s], "<u4")))
    release()
    return pd.DataFrame(out, columns=_COLUMNS)


def _several(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Requests for the bytes of segments whose anchor has several: rows (block, anchor, ord, pos)."""
    anchor, _, _, _, place, ord_, pos = _loaded(rows)
    order = np.argsort(anchor, kind="stable")
    anchor, place, ord_, pos = anchor[order], place[order], ord_[order], pos[order]
    same = np.zeros(len(anchor) + 1, dtype=bool)
    same[1:-1] = anchor[1:] == anchor[:-1]
    keep = same[1:] | same[:-1]
    anchor, place, ord_, pos = anchor[keep], place[keep], ord_[keep], pos[keep]
    order = np.argsort(place, kind="stable")
    anchor, place, ord_, pos = anchor[order], place[order], ord_[order], pos[order]
    edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(0, int)
    out = [(int(place[a]), ascending(anchor[a:z]), packed(ord_[a:z], "<u4"), packed(pos[a:z], "<u4")) for a, z in zip(edges[:-1], edges[1:])]
    release()
    return pd.DataFrame(out, columns=["block", "anchor", "ord", "pos"])


def _segments(block: pd.DataFrame, wanted: pd.DataFrame, length: int, ranges: int) -> pd.DataFrame:
    """The bytes asked for, by range of the anchor; a segment is padded with a byte of its own where the text ends."""
    columns = ["range", "block", "anchor", "doc", "th", "ord", "lo", "seg"]
    if not len(block) or not len(wanted):
        return pd.DataFrame(columns=columns)
    b, left = Block(block.iloc[0]), length - GRAM
    anchor, ord_, pos = (np.concatenate([f(x) for x in wanted[c]]) for c, f in (("anchor", from_ascending), ("ord", lambda x: unpacked(x, "<u4").astype(np.int64)), ("pos", lambda x: unpacked(x, "<u4").astype(np.int64))))
    order = np.argsort(anchor, kind="stable")
    anchor, ord_, pos = anchor[order], ord_[order], pos[order]
    cut = bounds(anchor, ranges)
    rows = []
    for r in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[r], cut[r + 1])
        o, p = ord_[s], pos[s]
        at = (b.offsets[o] + p - left)[:, None] + np.arange(left + length)
        inside = (at >= b.offsets[o][:, None]) & (at < b.offsets[o + 1][:, None])
        seg = np.where(inside, b.raw[np.clip(at, 0, len(b.raw) - 1)], PAD[0]).astype(np.uint8)
        rows.append((r, int(block["block"].iloc[0]), ascending(anchor[s]), packed(b.doc[o], "<i8"), packed(b.th[o], "<i8"), packed(o, "<u4"), packed(p - left + (1 << 16), "<u4"), zstandard.ZstdCompressor(level=3).compress(seg.tobytes())))
    release()
    return pd.DataFrame(rows, columns=columns)


def _collections(key: tuple, rows: pd.DataFrame, length: int, most: int) -> pd.DataFrame:
    """Covered intervals from all distinct segments of the anchors of a range."""
    width = 2 * length - GRAM
    blocks = rows["block"].to_numpy()
    anchor = [from_ascending(x) for x in rows["anchor"]]
    row = np.repeat(np.arange(len(anchor)), [len(x) for x in anchor])
    anchor = np.concatenate(anchor)
    doc, th, ord_, lo = (np.concatenate([unpacked(x, k) for x in rows[c]]).astype(np.int64) for c, k in (("doc", "<i8"), ("th", "<i8"), ("ord", "<u4"), ("lo", "<u4")))
    lo -= 1 << 16
    segs = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(-1, width) for x in rows["seg"]])
    order = np.argsort(anchor, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1], [True]]))
    found: list[tuple[np.ndarray, ...]] = []
    a = 0
    while a < len(order):
        # Whole anchors, about `most` segments together.
        z = edges[max(np.searchsorted(edges, a + most, side="right") - 1, np.searchsorted(edges, a) + 1)]
        own = order[a:z]
        own = own[np.lexsort((lo[own], ord_[own], row[own], th[own], doc[own]))]
        new = np.ones(len(own), dtype=bool)  # a place may come under two anchors
        new[1:] = (doc[own[1:]] != doc[own[:-1]]) | (th[own[1:]] != th[own[:-1]]) | (ord_[own[1:]] != ord_[own[:-1]]) | (lo[own[1:]] != lo[own[:-1]])
        own = own[new]
        first, last = covered_windows(segs[own], length)
        hit = np.flatnonzero(last >= 0)
        found.append((row[own[hit]], ord_[own[hit]], lo[own[hit]] + first[hit], lo[own[hit]] + last[hit] + length))
        a = int(z)
    row, ord_, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(4))
    out = [_cover_row(int(blocks[r]), ord_[row == r], lo[row == r], hi[row == r]) for r in np.unique(row).tolist()]
    release()
    return pd.DataFrame(out, columns=_COLUMNS)


def _kept(block: pd.DataFrame, covers: pd.DataFrame, length: int) -> pd.DataFrame:
    columns = ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if not len(block):
        return pd.DataFrame(columns=columns)
    b = Block(block.iloc[0])
    edge = np.zeros(len(b.raw) + 1, dtype=np.int32)
    for kind, ord_, lo, size in zip(covers["kind"], covers["ord"], covers["lo"], covers["size"]):
        ord_, lo = (unpacked(x, "<u4").astype(np.int64) for x in (ord_, lo))
        if kind == 0:
            lo = b.offsets[ord_] + lo
            hi = lo + unpacked(size, "<u4")
        else:
            lo, hi = b.edges(b.offsets[ord_] + lo, ord_, length)
            lo, hi = lo[hi - lo >= length], hi[hi - lo >= length]
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
    gone = np.cumsum(edge)[:-1] > 0
    start = gone.copy()
    start[1:] &= ~gone[:-1]
    inner = b.offsets[:-1][b.offsets[:-1] < len(gone)]
    start[inner] = gone[inner]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[b.offsets])
    sha = [hashlib.sha256(b.raw[i:j][~gone[i:j]].tobytes()).hexdigest() for i, j in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist())]
    release()
    return pd.DataFrame({"doc_id": b.doc, "th": b.th, "n_bytes": np.diff(b.offsets), "n_removed": total(gone), "n_spans": total(start), "kept_sha256": sha})


def remove_repeats(docs: DataFrame, length: int = 100, collection: int = COLLECTION) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of docs(doc_id, text).

    A string starts earlier in a smaller doc_id, or in the same document at a
    smaller byte.  A null text is empty; a null doc_id comes before all others;
    different texts with one doc_id come by the hash of the text, and rows that
    agree in both are one document, each with its result.  Texts shorter than
    `length` lose nothing; no rows give no rows.  Columns other than doc_id and
    text are not read.
    """
    small_batches(docs)
    nothing = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nothing)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ids = written(rows.select("doc_id", "th", F.octet_length("text").alias("size")), "ids")
    total = int(ids.agg(F.sum("size")).first()[0] or 0)
    repeated = ids.groupBy("doc_id", "th").count().where("count > 1").isEmpty() is False
    texts = rows.dropDuplicates(["doc_id", "th"]) if repeated else rows
    bits = min(64, max(8, (total // 20 + 2).bit_length() + 8))
    ranges = max(1, -(-total // RANGE_BYTES))
    blocks = bucketed(texts.mapInArrow(lambda it: _blocks(it, length, bits), "block long, doc binary, th binary, sizes binary, raw binary, at binary, words binary, n binary"), "block", max(1, -(-total // BLOCK_BYTES)), "texts")
    parts = blocks.select("block", "words", "n").mapInArrow(lambda it: _parts(it, ranges, bits), "range int, block long, words binary, n binary")
    answers = parts.groupBy("range").applyInPandas(summed, "range int, block long, n binary")
    by_block = blocks.drop("words", "n").groupBy("block")
    one = written(by_block.cogroup(answers.groupBy("block")).applyInPandas(lambda a, b: _occurrences(a, b, length, ranges, bits, collection), _ROWS), "occurrences")
    two = written(one.where("kind = 1").groupBy("key").applyInPandas(lambda k, x: _earliest(k, x, length, ranges), _ROWS), "earliest")
    wanted = two.where("kind = 1").groupBy("key").applyInPandas(_several, "block long, anchor binary, ord binary, pos binary")
    segments = by_block.cogroup(wanted.groupBy("block")).applyInPandas(lambda a, b: _segments(a, b, length, ranges), "range int, block long, anchor binary, doc binary, th binary, ord binary, lo binary, seg binary")
    three = segments.groupBy("range").applyInPandas(lambda k, x: _collections(k, x, length, collection), _ROWS)
    covers = one.where("kind = 0").unionByName(two.where("kind = 2")).unionByName(three).select("kind", F.col("key").alias("block"), "ord", "lo", "size")
    out = by_block.cogroup(covers.groupBy("block")).applyInPandas(lambda a, b: _kept(a, b, length), "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if repeated:
        out = ids.select("doc_id", "th").join(out, ["doc_id", "th"])
    return out.select(F.when(F.col("doc_id") != nothing, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
