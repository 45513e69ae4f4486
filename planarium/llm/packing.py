"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are dealt to shards by a hash of the row and its input partition, so
neither a hot source, nor a repeated or missing id, nor a large group of copies
meets in one task; each shard is packed on its own, the
longest pieces first.  Bins are kept in order of residual capacity and carry
two bitmaps: the duplicate clusters they hold, of which each may occur once,
and their sources, in planes that count up to the allowed number.  The search
for a bin starts at the smallest residual that fits and goes on to the next
larger one until the tightest compatible bin is found; without any, a bin is
opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.llm._store import small_batches

#: Documents of a shard (about).
SHARD_DOCS = 20_000


class Bins:
    """Open bins by residual; `mask` has a bit for each residual with a bin."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        self.clusters: list[int] = []
        self.planes: list[list[int]] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin: (bin, offset)."""
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        left = self.mask >> length << length
        while left:
            r = (left & -left).bit_length() - 1
            for i, b in enumerate(self.by_residual[r]):
                if not self.clusters[b] & c and not self.planes[b][-1] & s:
                    self.by_residual[r].pop(i)
                    if not self.by_residual[r]:
                        self.mask &= ~(1 << r)
                    return self._put(b, r, length, s, c)
            left &= left - 1
        self.clusters.append(0)
        self.planes.append([0] * self.per_source)
        return self._put(len(self.clusters) - 1, self.capacity, length, s, c)

    def _put(self, b: int, residual: int, length: int, s: int, c: int) -> tuple[int, int]:
        self.clusters[b] |= c
        for k, plane in enumerate(self.planes[b]):  # the first plane without the source takes it
            if not plane & s:
                self.planes[b][k] |= s
                break
        r = residual - length
        if r:
            self.by_residual[r].append(b)
            self.mask |= 1 << r
        return b, self.capacity - residual


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Bins of one shard; rows (doc_id, source, cluster, n)."""
    rows = rows.sort_values(["n", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable", na_position="last")
    sources = {s: i for i, s in enumerate(rows["source"].drop_duplicates())}
    counts = rows["cluster"].value_counts()
    clusters = {c: i for i, c in enumerate(counts[counts > 1].index)}
    bins = Bins(capacity, per_source)
    full = 0
    out = []
    for doc, source, cluster, n in zip(rows["doc_id"], rows["source"], rows["cluster"], rows["n"]):
        piece, at = 0, 0
        while n - at >= capacity:  # whole bins of a long document
            out.append((~full, doc, piece, at, capacity, 0))
            full, piece, at = full + 1, piece + 1, at + capacity
        if n > at or n == 0:
            b, offset = bins.place(n - at, sources[source], clusters.get(cluster, -1)) if n else (-1 << 40, 0)
            out.append((b, doc, piece, at, n - at, offset))
    got = pd.DataFrame(out, columns=["bin", "doc_id", "piece", "start", "length", "offset"])
    opened = len(bins.clusters)
    got["bin"] = [None if b == -1 << 40 else b if b >= 0 else opened + ~b for b in got["bin"]]
    return got


def best_fit(docs: DataFrame, capacity: int = 4096, per_source: int = 8, shard_docs: int = SHARD_DOCS, cluster: str | None = None) -> DataFrame:
    """Rows (shard, bin, doc_id, piece, start, length, offset) for the pieces of docs(doc_id, text, source).

    Lengths are counted in words of the whole text.  A document of the bin's
    capacity or more is cut into whole bins and a rest.  A bin holds no two
    documents of equal text (with `cluster`, a column of numbers: of one
    non-null cluster) and at most `per_source` pieces of one source.  A
    null source is a source of its own; a null or blank text has length 0 and
    one row without a bin; rows that repeat a doc_id are packed one by one; no
    rows give no rows.  Other columns are not read.  Bin numbers count from 0
    in each shard.
    """
    small_batches(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("\x00")).alias("source"), (F.col(cluster).cast("long") if cluster else F.xxhash64("text")).alias("cluster"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n"),
    )
    shards = max(1, -(-docs.count() // shard_docs))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "source", F.spark_partition_id()), F.lit(shards)).cast("long"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(group, capacity, per_source)
        out.insert(0, "shard", key[0])
        return out.astype({"bin": "Int64", "doc_id": "Int64"})

    return rows.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "shard long, bin long, doc_id long, piece long, start long, length long, offset long")
