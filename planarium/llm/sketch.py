"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch keeps the k smallest distinct 48-bit hashes of a document's shingles.
Sketches of parts merge into the sketch of the union, and any two estimate
resemblance, containment and distinct shingle counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.llm._store import small_batches
from planarium.llm._text import U64, shingle_sets, slices

K = 128
_BITS = 48


def sketch_sets(sets: list[np.ndarray], k: int = K) -> list[np.ndarray]:
    """The k smallest hashes of each sorted set, ascending and distinct."""
    out = []
    for s in sets:
        # The sets are sorted, so the smallest leading bits come first; a few more make up for ties.
        low = np.unique(s[: k + 32] >> U64(64 - _BITS))
        out.append((np.unique(s >> U64(64 - _BITS)) if len(low) < k < len(s) else low)[:k])
    return out


def encode(sketch: np.ndarray) -> str:
    """Six bytes a hash, as base64 text."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.reshape(-1).view(">u8").astype(U64)


#: Bytes of text of one range of ids (about), and most ranges; beyond, ranges grow instead.
PART_BYTES = 16 << 20
MOST_PARTS = 1 << 16

_COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained_next double"


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two sets from their sketches."""
    return np.union1d(a, b)[:k]


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[k - 1]) + 1) / 2.0**_BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two empty sets are alike, an empty one is unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    u = merge(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), u, assume_unique=True).sum()) / len(u)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set's shingles that the second has too."""
    if not len(a):
        return 1.0
    u = merge(a, b, k)
    return min(1.0, resemblance(a, b, k) * distinct_count(u, k) / distinct_count(a, k))


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([encode(s) for s in sketch_sets(shingle_sets(batch.column("text")), k)], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Rows (doc_id, fingerprint), one for each row of docs(doc_id, text).

    A null or blank text has the empty fingerprint; fewer than five words are
    one shingle; equal texts have equal fingerprints; doc_id may be null or
    repeat; no rows give no rows.  Columns other than these two are not read.
    """
    small_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _fingerprints(it, k), "doc_id long, fingerprint string")


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each document of a part beside its successor; a part is sorted and ends with the guard row that follows it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "contained_next"]
    last: tuple | None = None  # (part, doc_id, text, sketch) waiting for its successor

    def result(rows):
        edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for (_, _, t, _), (_, _, after, _) in rows]
        sketches = sketch_sets(shingle_sets(pa.array(edited, pa.string())), k)
        cols = [
            pa.array([r[1] for r, _ in rows], pa.int64()), pa.array([len(r[2]) for r, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array([encode(r[3]) for r, _ in rows], pa.string()), pa.array([encode(s) for s in sketches], pa.string()),
            pa.array([resemblance(r[3], s, k) for (r, _), s in zip(rows, sketches)], pa.float64()), pa.array([resemblance(r[3], n[3], k) for r, n in rows], pa.float64()),
            pa.array([distinct_count(r[3], k) for r, _ in rows], pa.float64()), pa.array([containment(r[3], n[3], k) for r, n in rows], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for batch in slices(batches):
        sketches = sketch_sets(shingle_sets(batch.column("text")), k)
        rows = []
        for part, guard, doc, text, s in zip(batch.column("part").to_pylist(), batch.column("guard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), sketches):
            now = (part, doc, text or "", s)
            if last is not None and last[0] == part:
                rows.append((last, now))
            last = None if guard else now
        if rows:
            yield result(rows)


def _range_of(cuts: np.ndarray):
    """Number of the range of an id, and whether the id is the cut that opens it."""

    @F.pandas_udf("part int, opens boolean")
    def found(x: pd.Series) -> pd.DataFrame:
        part = np.searchsorted(cuts, x.to_numpy(), side="right") - 1
        return pd.DataFrame({"part": part.astype("int32"), "opens": cuts[part] == x.to_numpy()})

    return found


def compared(docs: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness, and that to the next document.

    With them come the estimated number of distinct shingles and the estimated
    share of them that the next document has too.

    The edited text has its last quarter of code points replaced by the first
    as many of the document that follows in ascending doc_id (after the last:
    the first).  A null text is empty; rows with equal doc_id follow each other
    by text, nulls come first; a table of one row follows itself; no rows give
    no rows.  Columns other than doc_id and text are not read.

    Ids are cut into ranges at ids that occur, at most MOST_PARTS of them, so
    the cuts are of bounded size; a copy of the first row of each range goes to
    the range before it, so no row needs another task's rows.  A range streams
    through its task in order.
    """
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double")
    whole = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.min(key).alias("low")).first()
    if whole["low"] is None:
        return docs.sparkSession.createDataFrame([], _COMPARED)
    parts = min(MOST_PARTS, parts or max(1, -(-int(whole["bytes"]) // PART_BYTES)))
    inner = rows.select(key.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = np.unique([whole["low"], *inner])
    n = len(cuts)
    rows = rows.withColumn("r", _range_of(cuts)(key)).select("doc_id", "text", "r.part", "r.opens")
    first = rows.where("opens").groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    guards = first.select("r.doc_id", "r.text", F.pmod(F.col("part") - 1, F.lit(n)).cast("int").alias("part"), F.lit(True).alias("guard"))
    dealt = rows.select("doc_id", "text", "part", F.lit(False).alias("guard")).unionByName(guards)
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "guard", "doc_id", "text").mapInArrow(lambda it: _compare(it, k), _COMPARED)
