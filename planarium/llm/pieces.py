"""SentencePiece encoding through a table of distinct chunks.

A vocabulary whose pieces hold the whitespace marker only in front never joins
symbols across the step from a letter to a marker, so a text's ids are those of
its chunks (markers with what follows up to the next marker) one after another.
Texts are cut in blocks; each block keeps its distinct chunks and, for every
position, the number of the chunk there.  The distinct chunks of all blocks meet
by ranges of a hash, where each is segmented once; the ids go back to the blocks
and are put down by position.  Nothing here is compared by hash alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from planarium.llm._pack import pack_strings, packed, unpack_strings, unpacked
from planarium.llm._store import bucketed, small_batches, written
from planarium.llm._text import U64, prefix_hash, release, span_hash, utf8

#: Bytes of text of a block, and those whose distinct chunks one task segments.
BLOCK_BYTES, RANGE_BYTES = 1 << 24, 1 << 26
MARKER = "▁"


def _processor(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def check_model(model_file: str) -> None:
    """An error unless chunks are independent under the model: no piece with a marker behind another symbol, texts taken as they are."""
    sp = _processor(model_file)
    if any(MARKER in sp.id_to_piece(i).lstrip(MARKER) for i in range(sp.vocab_size())):
        raise ValueError("a piece of this model crosses a whitespace marker")
    probe = "ℌ　 ﬁ\t  x "
    if sp.normalize(probe) != MARKER + probe.replace(" ", MARKER):
        raise ValueError("this model rewrites texts before it cuts them")



def chunks(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All chunks of texts in order, and the number of them in each text; a text gets a space in front, as the library does."""
    size = np.diff(offsets)
    full = size > 0
    at = offsets[:-1] + np.cumsum(full) - full  # where each text starts once the spaces are in
    out = np.empty(len(buf) + int(full.sum()), dtype=np.uint8)
    text = np.ones(len(out), dtype=bool)
    text[at[full]] = False
    out[text], out[~text] = buf, 0x20
    marker = out == 0x20
    wide = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81)) if len(out) > 2 else np.zeros(0, np.int64)
    for k in range(3):
        marker[wide + k] = True
    start = marker.copy()
    start[1:] &= ~marker[:-1]
    start[at[full]] = True
    first = np.flatnonzero(start)
    edges = np.append(first, len(out)).astype(np.int64)
    per = np.searchsorted(first, np.append(at, len(out)))
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(out)]), np.diff(per)


def ranges_of(words: pa.Array, ranges: int) -> np.ndarray:
    """The range of each string, by a hash of its bytes."""
    buf, offsets = utf8(words)
    h = span_hash(prefix_hash(buf), offsets[:-1], offsets[1:])
    return ((h >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


def _cut(ranges: int):
    """Blocks (block, layout, words): per range the block's distinct chunks; the layout has ids, counts and the chunk at each position."""

    def block(number: int, ids: list, texts: list) -> pa.RecordBatch:
        buf, offsets = utf8(pa.chunked_array(texts))
        found, per = chunks(buf, offsets)
        coded = found.dictionary_encode() if len(found) else pa.array([], pa.large_string()).dictionary_encode()
        own = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False)
        r = ranges_of(own, ranges) if len(own) else np.zeros(0, np.int64)
        # Numbers by range, then by first occurrence: a range's ids come back in this order.
        order = np.argsort(r, kind="stable")
        number_of = np.empty(len(own), dtype=np.uint32)
        number_of[order] = np.arange(len(own), dtype=np.uint32)
        cut = np.concatenate([[0], np.searchsorted(r[order], np.arange(1, ranges)), [len(own)]])
        held = own.take(pa.array(order))
        words = [pack_strings(held.slice(a, b - a)) if b > a else None for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        d = pa.chunked_array(ids).combine_chunks().cast(pa.int64())
        known = d.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        layout = pa.scalar({"doc": packed(d.fill_null(0).to_numpy(), "<i8"), "known": packed(known, "u1"), "per": packed(per, "<i8"), "at": packed(number_of[code], "<u4")}, LAYOUT)
        release()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([layout.as_py()], LAYOUT), pa.array([words], pa.list_(pa.binary()))], ["block", "layout", "words"])

    def cut(batches):
        task, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < b.num_rows:
                base = sizes[a - 1] if a else 0
                to = max(a + 1, int(np.searchsorted(sizes, base + BLOCK_BYTES - held, side="right")))
                ids.append(b.column("doc_id").slice(a, to - a))
                texts.append(b.column("text").slice(a, to - a))
                held += int(sizes[to - 1] - base)
                if held >= BLOCK_BYTES or to < b.num_rows:
                    yield block(task << 32 | number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
                a = to
        if ids:
            yield block(task << 32 | number, ids, texts)

    return cut


LAYOUT = pa.struct([("doc", pa.binary()), ("known", pa.binary()), ("per", pa.binary()), ("at", pa.binary())])
_BLOCKS = "block long, layout struct<doc: binary, known: binary, per: binary, at: binary>, words array<binary>"


def segmented(model_file: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids of chunks; the library puts back the marker that each loses here."""
    sp = _processor(model_file)
    alone = sp.piece_to_id(MARKER)
    lengths, ids = np.zeros(len(words), np.uint32), []
    for a in range(0, len(words), 20_000):
        got = [x or [alone] for x in sp.encode([w[1:] for w in words[a : a + 20_000]], num_threads=1)]
        lengths[a : a + len(got)] = [len(x) for x in got]
        ids.append(np.array([i for x in got for i in x], dtype=np.uint32))
    return lengths, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all spans, one span after another."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def _distinct(payloads: list[bytes]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct strings of some packed lists, and each list as numbers of them."""
    lists = [unpack_strings(x) for x in payloads]
    coded = pa.chunked_array(lists).combine_chunks().dictionary_encode()
    return coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(x) for x in lists])[:-1])


def _answer(model_file: str):
    """Of a range: segment each distinct chunk of all blocks once, and give each block the ids of its own."""

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        own, lists = _distinct(list(rows["payload"]))
        lengths, ids = segmented(model_file, own.to_pylist())
        lengths = lengths.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        out = [(packed(lengths[x], "<u4"), packed(ids[spans(starts[x], lengths[x])], "<u4")) for x in lists]
        release()
        return pd.DataFrame({"block": rows["block"], "range": rows["range"], "lengths": [x for x, _ in out], "ids": [x for _, x in out]})

    return answer


def _assemble(layouts: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows (doc_id, ids) of a block."""
    order = np.argsort(answers.column("range").to_numpy())
    take = lambda c: [unpacked(answers.column(c)[int(i)].as_py(), "<u4") for i in order]
    none = [np.zeros(0, np.uint32)]
    lengths, ids = np.concatenate(none + take("lengths")).astype(np.int64), np.concatenate(none + take("ids"))
    starts = np.cumsum(lengths) - lengths
    layout = layouts.column("layout")[0].as_py()
    at, per = unpacked(layout["at"], "<u4"), unpacked(layout["per"], "<i8")
    doc = pa.array(unpacked(layout["doc"], "<i8"), mask=unpacked(layout["known"], "u1") == 0)
    upto, flat, d = np.concatenate([[0], np.cumsum(per)]), [], 0
    while d < len(per):  # texts of about a million chunks at once
        to = max(d + 1, int(np.searchsorted(upto, upto[d] + 1_000_000, side="right")) - 1)
        own = at[upto[d] : upto[to]]
        long = lengths[own]
        ends = np.concatenate([[0], np.cumsum(long)])[upto[d : to + 1] - upto[d]]
        flat.append(pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids[spans(starts[own], long)].astype(np.int32))))
        d = to
    rows = pa.chunked_array(flat, pa.large_list(pa.int32())).cast(pa.list_(pa.int32()))
    release()
    return pa.table({"doc_id": doc, "ids": rows})


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """Rows (doc_id, ids): the library's ids of each whole text, without begin or end.

    One row for each row of `docs`, whatever repeats; a null or empty text has
    no ids, a null doc_id stays null, no documents give no rows.  Other columns
    are ignored.  A block holds one text at least, so a task holds its longest
    text and otherwise about BLOCK_BYTES.
    """
    check_model(model_file)
    blocks, ranges = _blocks(docs)
    asked = blocks.select("block", F.posexplode("words").alias("range", "payload")).where("payload is not null")
    ids = asked.groupBy("range").applyInPandas(_answer(model_file), "block long, range int, lengths binary, ids binary")
    got = blocks.select("block", "layout").groupBy("block").cogroup(ids.groupBy("block"))
    return got.applyInArrow(_assemble, "doc_id long, ids array<int>")


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of the texts, written; more text gets more ranges."""
    small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    return bucketed(docs.mapInArrow(_cut(ranges), _BLOCKS), "block", ranges, "pieces"), ranges


def chunk_table(docs: DataFrame, model_file: str) -> DataFrame:
    """Rows (chunk, ids): every distinct chunk of all texts once, its first marker as a space where the text had one."""
    check_model(model_file)
    blocks, _ = _blocks(docs)

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        own, _ = _distinct(list(rows["payload"]))
        lengths, ids = segmented(model_file, own.to_pylist())
        return pd.DataFrame({"chunk": own.to_pylist(), "ids": np.split(ids.astype(np.int32), np.cumsum(lengths)[:-1])})

    asked = blocks.select(F.posexplode("words").alias("range", "payload")).where("payload is not null")
    return asked.groupBy("range").applyInPandas(table, "chunk string, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids), by the library's decode; null ids give a null text."""

    def texts(batches):
        sp = _processor(model_file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else sp.decode(x) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def digests(encoded: DataFrame, model_file: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids)."""

    def digest(batches):
        sp = _processor(model_file)
        name = [str(i).encode() for i in range(sp.vocab_size())]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids, texts = [], [], []
            for x in b.column("ids"):
                x = x.values.to_numpy(zero_copy_only=False).tolist()
                n.append(len(x))
                ids.append(sha(b",".join([name[i] for i in x])))
                texts.append(sha(sp.decode(x).encode()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            release()

    return encoded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
