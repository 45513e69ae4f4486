"""Token counts as rollups that signed deltas maintain.

The store is a folder of committed batches.  A batch holds, for each document
it touches, the document's new state, and the signed sums by source, language
and tokenizer version that lead from the old states to the new ones.  Totals
are the sums of all batches.  A batch is committed by a mark of its own;
committing it again changes nothing, and a batch that was cut off leaves no
trace in the totals and is written anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarium.llm._store import small_batches
from planarium.llm._text import slices
from planarium.llm.wavelet import word_encoder

KEYS = ["source", "lang", "version"]
_STATE = "doc_id long, source string, lang string, version string, n_tokens long, live boolean, batch long"
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long, batch long"


class TokenLedger:
    """A rollup store in `path`, any folder that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _has(self, path: str) -> bool:
        return self.fs.exists(self.jvm_path(path))

    def _marked(self) -> dict[str, list[int]]:
        """Numbers of the batches and bases that count: those whose mark is set."""
        out: dict[str, list[int]] = {"batch": [], "base": []}
        if self._has(f"{self.path}/deltas"):
            for name in (x.getPath().getName() for x in self.fs.listStatus(self.jvm_path(f"{self.path}/deltas"))):
                kind, _, number = name.partition("-")
                if kind in out and self._has(f"{self.path}/deltas/{name}/_committed"):
                    out[kind].append(int(number))
        return {k: sorted(v) for k, v in out.items()}

    def _mark(self, name: str) -> None:
        self.fs.create(self.jvm_path(f"{self.path}/deltas/{name}/_committed"), True).close()

    def committed(self) -> list[int]:
        """Numbers of the batches that count."""
        return self._marked()["batch"]

    def _read(self, kind: str, schema: str) -> DataFrame:
        marked = self._marked()
        base = marked["base"][-1:]
        names = [f"base-{b:08d}" for b in base] + [f"batch-{b:08d}" for b in marked["batch"] if not base or b > base[0]]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def _write(self, name: str, batch: int, states: DataFrame, deltas) -> None:
        """States first, and deltas(states as written), so that changes are computed once; without the mark beside the deltas neither is read."""
        path = f"{self.path}/states/{name}"
        states.select("doc_id", *KEYS, "n_tokens", "live", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(path)
        found = deltas(self.spark.read.schema(_STATE).parquet(path))
        found.select(*KEYS, "n_docs", "n_tokens", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        self._mark(name)

    def compact(self) -> None:
        """Fold all batches into a base, so that later commits and totals read that and what follows it."""
        batches = self.committed()
        if batches:
            self._write(f"base-{batches[-1]:08d}", batches[-1], self.state().where("live"), lambda _: self.totals())

    def state(self) -> DataFrame:
        """The last committed state of each document."""
        last = F.max_by(F.struct("source", "lang", "version", "n_tokens", "live"), "batch").alias("s")
        return self._read("states", _STATE).groupBy("doc_id").agg(last).select("doc_id", "s.*")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes(op, doc_id, source, lang, version, n_tokens); False if the batch is in already.

        op is insert, revise or delete.  The last of several changes of one
        document counts: revise before insert before delete, then the larger
        values.  Insert and revise both replace a live document; deleting what
        isn't there changes nothing.  Rows with a null doc_id or op are left
        out.  Null sources and languages are keys of their own, a null count is
        0.  Further columns are not read.

        Batches are committed in ascending order by one writer: the deltas of a
        batch depend on the states before it, so a batch below the last one that
        isn't in already is an error.
        """
        committed = self.committed()
        if batch in committed:
            return False
        if committed and batch < committed[-1]:
            raise ValueError(f"batch {batch} comes after batch {committed[-1]}")
        rank = F.when(F.col("op") == "revise", 2).when(F.col("op") == "insert", 1).otherwise(0)
        new = changes.where("doc_id is not null and op in ('insert', 'revise', 'delete')").select("doc_id", F.struct(rank.alias("r"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "source", "lang", "version").alias("c"))
        new = new.groupBy("doc_id").agg(F.max("c").alias("c")).select(F.col("doc_id").cast("long").alias("doc_id"), "c.source", "c.lang", "c.version", "c.n_tokens", (F.col("c.r") > 0).alias("live"))
        old = self.state().where("live")

        def deltas(new: DataFrame) -> DataFrame:
            touched = old.join(new.select("doc_id"), "doc_id", "left_semi")
            minus = touched.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
            plus = new.where("live").select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")
            return plus.unionByName(minus).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

        self._write(f"batch-{batch:08d}", batch, new, deltas)
        return True

    def totals(self) -> DataFrame:
        """Rows (source, lang, version, n_docs, n_tokens) of what is live."""
        sums = self._read("deltas", _DELTA).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(path)
    for batch in slices(batches, most=2 << 20):
        _, n = encoder.encode(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "version")), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "version", "n_tokens"])


def count_tokens(docs: DataFrame, version: str, tokenizer: str) -> DataFrame:
    """docs(doc_id, text, source, lang) with version and n_tokens in place of the text; a null text has 0.

    `tokenizer` is the path of a tokenizer file; `version` names it in the store.
    """
    small_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"))
    return rows.mapInArrow(lambda it: _counts(it, tokenizer), "doc_id long, source string, lang string, version string, n_tokens long")
