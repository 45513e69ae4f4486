"""Token ids as wavelet matrices: one compressed file per shard.

A shard keeps the token ids of consecutive documents as the bit-planes of a
wavelet matrix over the shard's own alphabet.  Planes are compressed in blocks
that can be read alone, beside a directory of the ones before each block.  So
`WaveletFile` answers access(i), rank(token, i) and select(token, j) from the
compressed file with one block a plane; `decode` restores all ids at once.

File format (little-endian): the magic b"PWM2"; six unsigned 64-bit numbers
(tokens n, alphabet size s, planes k, documents d, blocks of a plane m, bytes
of the head); the head, zstd-compressed: s uint32 alphabet values in ascending
order, d int64 document ids, d uint8 flags (1: the row has no id), d uint64
token counts, k x (m + 1) uint32 ones before each block of a plane and in all,
k x m + 1 uint64 offsets of blocks after the head; then the blocks, plane after
plane, most significant first, each 8192 bytes or the rest of the plane, bits
in numpy's big order, zstd-compressed on its own.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planarium.llm._store import new_path, small_batches, written
from planarium.llm._text import prefix_hash, slices, span_hash, utf8

MAGIC = b"PWM2"
#: Token ids of one shard before it is closed (a longer document makes a longer shard).
SHARD_TOKENS = 1_000_000
#: Words whose ids one Python worker remembers.
REMEMBERED = 2_000_000
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: Bytes of a plane between two counts in memory, and in one block of the file.
_STEP, _BLOCK = 64, 8192


def _before(plane: np.ndarray, step: int) -> np.ndarray:
    """Ones before each `step` bytes of a plane, and in all."""
    ones = np.zeros(-(-len(plane) // step) * step, dtype=np.uint8)
    ones[: len(plane)] = _ONES[plane]
    return np.concatenate([[0], np.cumsum(ones.reshape(-1, step).sum(axis=1, dtype=np.int64))])


class _Ranked:
    """Access, rank and select by the ones before a position (`_ones`) and the bit there (`_bit`) of each plane."""

    alphabet: np.ndarray
    n: int
    levels: int
    _zeros: list[int]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        raise NotImplementedError

    def _bit(self, level: int, i: int) -> int:
        raise NotImplementedError

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self._zeros[level] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of a token among the first i ids (all, without i)."""
        code, lo, hi = self._code(token), 0, self.n if i is None else min(i, self.n)
        if code is None:
            return 0
        for level in range(self.levels):
            bit = code >> (self.levels - 1 - level) & 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self._zeros[level] + a, self._zeros[level] + b) if bit else (lo - a, hi - b)
        return hi - lo

    count = rank

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence (from 0) of a token; -1 if there are fewer."""
        code = self._code(token)
        if code is None or not 0 <= j < self.rank(token):
            return -1
        at, bits = 0, [code >> (self.levels - 1 - k) & 1 for k in range(self.levels)]
        for level, bit in enumerate(bits):
            a = self._ones(level, at)
            at = self._zeros[level] + a if bit else at - a
        at += j
        for level in range(self.levels - 1, -1, -1):
            target = at - self._zeros[level] if bits[level] else at
            lo, hi = 0, self.n
            while lo < hi:  # the smallest prefix with more than `target` such bits
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                if (ones if bits[level] else mid + 1 - ones) > target:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at


class WaveletMatrix(_Ranked):
    """Bit-planes in memory."""

    def __init__(self, alphabet: np.ndarray, planes: list[np.ndarray], n: int):
        self.alphabet, self.planes, self.n, self.levels = alphabet, planes, n, len(planes)
        self._counts = [_before(p, _STEP) for p in planes]
        self._zeros = [n - int(c[-1]) for c in self._counts]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=bool)
        seen[ids] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        code = np.zeros(len(seen), dtype=np.uint32 if len(alphabet) > 65536 else np.uint16)
        code[alphabet] = np.arange(len(alphabet))
        x, planes = code[ids], []
        for level in range(max(len(alphabet) - 1, 0).bit_length() - 1, -1, -1):
            bit = (x & x.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit))
            x = np.concatenate([x[~bit], x[bit]])
        return cls(alphabet, planes, len(ids))

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        kind = np.uint32 if len(self.alphabet) > 65536 else np.uint16
        x = np.zeros(self.n, dtype=kind)
        for level, (p, zeros) in enumerate(zip(reversed(self.planes), reversed(self._zeros))):
            bit = np.unpackbits(p, count=self.n).view(bool)
            y = np.empty(self.n, dtype=kind)
            y[~bit] = x[:zeros]
            y[bit] = x[zeros:] | kind(1 << level)
            x = y
        return self.alphabet[x] if self.n else np.zeros(0, np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        byte, step = i >> 3, (i >> 3) // _STEP
        p = self.planes[level]
        n = int(self._counts[level][step]) + int(_ONES[p[step * _STEP : byte]].sum())
        return n + (bin(int(p[byte]) >> (8 - (i & 7))).count("1") if i & 7 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

class WaveletFile(_Ranked):
    """A shard's file, opened for random access; only the head and the blocks asked for are read and kept."""

    def __init__(self, f):
        self._f = f
        f.seek(0)
        if f.read(4) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, s, self.levels, d, self._m, size = struct.unpack("<6Q", f.read(48))
        head = zstandard.ZstdDecompressor().decompress(f.read(size))
        self._base, at = 52 + size, 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(head, kind, count, at)
            at += out.nbytes
            return out

        self.alphabet, docs, none, self.lengths = take("<u4", s), take("<i8", d), take(np.uint8, d), take("<u8", d)
        self.docs = [None if x else y for x, y in zip(none.tolist(), docs.tolist())]
        self._counts = take("<u4", self.levels * (self._m + 1)).reshape(self.levels, self._m + 1).astype(np.int64)
        self._offsets = take("<u8", self.levels * self._m + 1)
        self._zeros = [self.n - int(c[-1]) for c in self._counts]
        self._read: dict[tuple[int, int], np.ndarray] = {}

    def block(self, level: int, b: int) -> np.ndarray:
        """The bytes of one block of a plane."""
        if (level, b) not in self._read:
            i = level * self._m + b
            self._f.seek(self._base + int(self._offsets[i]))
            raw = self._f.read(int(self._offsets[i + 1] - self._offsets[i]))
            self._read[level, b] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        return self._read[level, b]

    def _ones(self, level: int, i: int) -> int:
        byte, b = i >> 3, (i >> 3) // _BLOCK
        if b == self._m:
            return int(self._counts[level][b])
        p = self.block(level, b)
        n = int(self._counts[level][b]) + int(_ONES[p[: byte - b * _BLOCK]].sum(dtype=np.int64))
        return n + (bin(int(p[byte - b * _BLOCK]) >> (8 - (i & 7))).count("1") if i & 7 else 0)

    def _bit(self, level: int, i: int) -> int:
        b = (i >> 3) // _BLOCK
        return int(self.block(level, b)[(i >> 3) - b * _BLOCK]) >> (7 - (i & 7)) & 1

    def matrix(self) -> WaveletMatrix:
        """All planes, in memory."""
        planes = [np.concatenate([self.block(k, b) for b in range(self._m)]) if self._m else np.zeros(0, np.uint8) for k in range(self.levels)]
        return WaveletMatrix(self.alphabet, planes, self.n)


def pack(ids: np.ndarray, docs: list[int | None], lengths: list[int]) -> bytes:
    """A shard's file."""
    m = WaveletMatrix.build(ids)
    zip_ = zstandard.ZstdCompressor(level=1).compress
    many = -(-(-(-m.n // 8)) // _BLOCK)
    blocks = [zip_(p[b * _BLOCK : (b + 1) * _BLOCK].tobytes()) for p in m.planes for b in range(many)]
    counts = np.array([_before(p, _BLOCK) for p in m.planes], dtype="<u4")
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype("<u8")
    head = zip_(b"".join([m.alphabet.astype("<u4").tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes(), counts.tobytes(), offsets.tobytes()]))
    return b"".join([MAGIC, struct.pack("<6Q", m.n, len(m.alphabet), len(m.planes), len(docs), many, len(head)), head, *blocks])


def unpack(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and token counts of a shard's file, read whole."""
    f = WaveletFile(io.BytesIO(data))
    return f.matrix(), f.docs, f.lengths


class WordEncoder:
    """The ids of a byte-level tokenizer, with each distinct word encoded once.

    The byte-level pre-tokenizer never joins a non-space character with a
    space after it.  So, unless a space is followed by more white space, a text
    cut before each space encodes piece by piece to the same ids.  Pieces are
    told apart by 64-bit hashes; a new one is cut by the published pattern of
    this pre-tokenizer, and the library's model encodes its words in the byte
    alphabet.  Texts with other white space, pieces that hold an added token,
    and tokenizers of another kind go through the library whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.plain = self.plain and not any(" " in x for x in self.added)
        # Fixed value: the pattern of the byte-level pre-tokenizer.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.reset()

    def reset(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _one(self, piece: str) -> list[int]:
        bare = piece[1:] if piece[:1] == " " else piece
        if bare == "" or any(x in bare for x in self.added):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        if bare.isalpha():
            found = (piece,)
        elif bare[-1] in ".,;:!?" and bare[:-1].isalpha():
            found = (piece[:-1], piece[-1])
        else:
            found = self.words(piece)
        tokenize, letters = self.model.tokenize, self.letters
        return [x.id for w in found for x in tokenize((w if w.isascii() else w.encode().decode("latin-1")).translate(letters))]

    def _odd(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts in which a space is followed by white space, or may be."""
        follows = np.zeros(256, dtype=bool)
        follows[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
        at = np.flatnonzero((buf[:-1] == 0x20) & follows[buf[1:]])
        wide = buf[at + 1] >= 0xC2
        third = buf[np.minimum(at + 2, len(buf) - 1)]
        sure = ~wide | ((buf[at + 1] == 0xC2) & ((third == 0x85) | (third == 0xA0))) | ((buf[at + 1] > 0xC2) & (third <= 0x9A))
        at = at[sure]
        doc = np.searchsorted(offsets, at, side="right") - 1
        return np.unique(doc[at + 1 < offsets[doc + 1]])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each has."""
        buf, offsets = utf8(column)
        n = len(offsets) - 1
        if not self.plain:
            whole = np.arange(n)
        else:
            whole = self._odd(buf, offsets) if len(buf) else np.zeros(0, np.int64)
        cut = buf == 0x20
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        first = np.searchsorted(starts, offsets)
        h = span_hash(prefix_hash(buf), starts, ends)
        u, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        at[at == len(self.keys)] = 0
        new = np.flatnonzero(self.keys[at] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            raw = buf.tobytes()
            ids = [self._one(raw[s:e].decode()) for s, e in zip(starts[index[new]].tolist(), ends[index[new]].tolist())]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            if len(self.keys) + len(new) > REMEMBERED and len(self.keys):
                self.reset()
                return self.encode(column)
            where = np.searchsorted(self.keys, u[new])
            self.rows = np.insert(self.rows, where, np.arange(len(new)) + len(self.rows))
            self.keys = np.insert(self.keys, where, u[new])
            self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])
            self.counts = np.concatenate([self.counts, counts])
            at = np.searchsorted(self.keys, u)
        row = self.rows[at][inverse]
        size, at = self.counts[row], (np.cumsum(self.counts) - self.counts)[row]
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(total[-1]) - np.repeat(total[:-1] - at, size)
        out, stops = self.flat[index], total[first]
        if not len(whole):
            return out, np.diff(stops)
        parts = [out[stops[i] : stops[i + 1]] for i in range(n)]
        texts = column.take(pa.array(whole)).to_pylist()
        for i, text in zip(whole.tolist(), texts):
            parts[i] = np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))


def _write_shards(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    """Encode sorted documents and write a file for each run of them; one row a file.

    A file appears under its name only when it is whole, and a task that runs again writes the same files.
    """
    fs, root = _open(folder)
    encoder, part, seq = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    lengths: list[int] = []
    held: list[np.ndarray] = []
    total = 0

    def close():
        nonlocal docs, lengths, held, total, seq
        name = f"part-{part:06d}-{seq:05d}.pwm"
        temporary = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temporary) as f:
            f.write(pack(np.concatenate(held), docs, lengths))
        if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
            fs.delete_file(f"{root}/{name}")  # of an earlier attempt: not every store renames onto a name in use
        fs.move(temporary, f"{root}/{name}")
        row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "name": [name], "n_docs": [len(docs)], "n_tokens": [total]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
        docs, lengths, held, total, seq = [], [], [], 0, seq + 1
        return row

    for batch in slices(batches, most=2 << 20):
        ids, counts = encoder.encode(batch.column("text"))
        ids = np.insert(ids, np.cumsum(counts), end)
        lengths += (counts + 1).tolist()
        docs += batch.column("doc_id").to_pylist()
        held.append(ids)
        total += len(ids)
        if total >= shard_tokens:
            yield close()
    if docs:
        yield close()


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs(doc_id, text) as wavelet-matrix files in ascending doc_id order; returns the manifest.

    The manifest has (part, seq, name, n_docs, n_tokens, start): files in order
    of (part, seq), start the number of ids in all files before.  A null text is
    empty and holds the end id alone; a null doc_id comes first; rows that
    repeat a doc_id are ordered by text; no rows give no files and an empty
    manifest.  Columns other than doc_id and text are not read.
    """
    small_batches(docs)
    spark = docs.sparkSession
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(lambda it: _write_shards(it, folder, tokenizer, end, shard_tokens), "part int, seq int, name string, n_docs long, n_tokens long"), "manifest")
    # Sums by range partition are as few as the partitions; within a partition the files are summed on their own.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = parts.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("ahead"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return written(files.withColumn("inner", inner).join(before, "part").select("part", "seq", "name", "n_docs", "n_tokens", (F.col("ahead") + F.col("inner")).alias("start")), "manifest")


def _read_shards(batches: Iterator[pa.RecordBatch], folder: str, end: int | None) -> Iterator[pa.RecordBatch]:
    fs, root = _open(folder)
    for batch in batches:
        for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
            with fs.open_input_stream(f"{root}/{name}") as f:
                m, docs, lengths = unpack(f.read())
            if end is not None and m.count(end) < len(docs):
                raise ValueError(f"{name} has fewer ends than documents")
            ids = m.decode().astype("<u4")
            ends = np.cumsum(lengths.astype(np.int64))
            raw = memoryview(ids).cast("B")
            starts = ends - lengths.astype(np.int64)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64()), pa.array([name] * len(docs), pa.string())], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])


def read_token_shards(manifest: DataFrame, folder: str, end: int | None = None) -> DataFrame:
    """Decode the files of a manifest: (doc_id, start, n_tokens, ids_crc32, file) for each document.

    With `end`, each file must hold that id as often as documents.
    """
    tasks = manifest.select("name", "start")
    # A fixed number of tasks: the manifest is small, the files are not.
    tasks = tasks.repartition(max(1, -(-tasks.count() // 4)), "name")
    return tasks.mapInArrow(lambda it: _read_shards(it, folder, end), "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_shards(docs: DataFrame, tokenizer: str, end: int = 0, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Write the shards and describe each document from the files read back."""
    folder = folder or new_path(docs.sparkSession, "wavelet")
    return read_token_shards(write_token_shards(docs, folder, tokenizer, end, shard_tokens), folder, end)


def occurrences(manifest: DataFrame, folder: str, token: int, most: int = 100) -> DataFrame:
    """Rows (file, n, positions): how often a token occurs in each file, and where first, from rank and select alone.

    Positions count over all files and are limited to `most` a file; only the
    blocks on the way are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    m = WaveletFile(f)
                    n = m.count(token)
                    at = [start + m.select(token, j) for j in range(min(n, most))]
                yield pa.RecordBatch.from_pydict({"file": [name], "n": [n], "positions": [at]}, schema=pa.schema([("file", pa.string()), ("n", pa.int64()), ("positions", pa.list_(pa.int64()))]))

    return manifest.select("name", "start").repartition(max(1, -(-manifest.count() // 4)), "name").mapInArrow(run, "file string, n long, positions array<long>")
