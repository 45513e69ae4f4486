"""Language model scores by a weighted backoff automaton over words.

The model has n-grams up to `order` words, smoothed by the next shorter ones:
P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m), with h' the context without its
first word, and at the root the smoothed unigrams.  As an automaton, each
context seen in training is a state.  It has an arc for every word seen after
it, weighted with the smoothed log-probability, and a failure arc to the state
of h', weighted with m / (c(h) + m).  One traversal from left to right carries
the state: a word without an arc follows failure arcs until one is found, and
leads to the state of the longest seen context that it ends.

Counting and scoring are spread over blocks of documents, which are written
once in a table bucketed by block.  A block sends the hashes of the n-grams it
holds, each once, with its training counts, to ranges of the hash space; a
range sums what all blocks counted and answers each block for its own n-grams.
So a task holds the n-grams of one block or one range, never the model, a
frequent word is one number a block, and the rows exchanged are never more
than the n-grams.  A context's count is that of the n-gram it is, as every word
but the last of a text is followed by another.  All n-grams of training count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.llm._pack import bounds, packed, unpacked
from planarium.llm._store import bucketed, small_batches
from planarium.llm._text import U64, mix, release, slices, word_hashes

#: Tokens of a block (about; a longer document is a block by itself), and n-grams that one range sums (about).
BLOCK_TOKENS, RANGE_NGRAMS = 1_100_000, 2_000_000
#: Words of the longest n-gram, and the weight m of the shorter ones.
ORDER, STRENGTH = 3, 2.0
END = U64(0xE4D0E4D0E4D0E4D0)
START = U64(0x57A257A257A257A2)
_TURN = U64(0x9FB21C651E98DF25)


def _runs(x: np.ndarray) -> bytes:
    """Hashes by their differences, in byte planes compressed one by one: the low ones are random, the high ones nearly empty."""
    d = np.diff(x, prepend=U64(0))
    planes = [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) if p.any() else b"" for p in np.ascontiguousarray(d.view(np.uint8).reshape(len(d), 8).T)]
    return np.array([len(d), *map(len, planes)], dtype="<u4").tobytes() + b"".join(planes)


def _from_runs(data: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(data[:36], dtype="<u4").tolist()
    out, at = np.zeros((8, n), dtype=np.uint8), 36
    for k, size in enumerate(sizes):
        if size:
            out[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), np.uint8)
        at += size
    return np.cumsum(np.ascontiguousarray(out.T).view("<u8").reshape(-1), dtype=U64)


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Tokenised blocks: their distinct words, the texts as numbers of these, ids, lengths and folds of the documents."""
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []

    def close():
        nonlocal held, size, seq
        tokens, lengths, docs, out = (np.concatenate([h[i] for h in held]) for i in range(4))
        words, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
        # Frequent words first, so that most numbers are small; by their hashes among those that are about as frequent.
        order = np.argsort(-np.frexp(n)[1], kind="stable")
        number = np.empty(len(words), dtype=np.int64)
        number[order] = np.arange(len(words))
        words, inverse = words[order], number[inverse]
        row = {"block": [part << 32 | seq], "words": [_runs(words)], "tokens": [packed(inverse, "<u4")], "docs": [packed(docs, "<i8")], "lengths": [packed(lengths, "<u4")], "held": [packed(out, "u1")], "size": [len(tokens)], "train": [int(lengths[~out].sum())]}
        held, size, seq = [], 0, seq + 1
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in list(row)[1:6]), ("size", pa.int64()), ("train", pa.int64())]))

    for batch in slices(batches):
        h, first = word_hashes(batch.column("text"))
        tokens = np.insert(h, first[1:], END)
        held.append((tokens, np.diff(first) + 1, batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)))
        size += len(tokens)
        if size >= block_tokens:
            yield close()
    if held:
        yield close()


class Block:
    """A block's texts, each with a start mark before it, and the hashes of all its n-grams.

    keys[o - 1][p] is the n-gram of o words that ends at place p; place[o - 1]
    are the places where there is one.
    """

    def __init__(self, row: dict, order: int):
        words, lengths = _from_runs(row["words"]), unpacked(row["lengths"], "<u4").astype(np.int64)
        self.docs, self.held, self.lengths = unpacked(row["docs"], "<i8"), unpacked(row["held"], "u1").astype(bool), lengths
        self.first = np.cumsum(lengths + 1) - lengths - 1
        at = np.ones(int((lengths + 1).sum()), dtype=bool)
        at[self.first] = False
        seq = np.full(len(at), START)
        seq[at] = words[unpacked(row["tokens"], "<u4")]
        self.word = at
        within = np.arange(len(at)) - np.repeat(self.first, lengths + 1)
        self.keys, self.place = [], []
        key = seq
        for o in range(1, order + 1):
            if o > 1:
                key = key.copy()
                key[o - 1 :] += _TURN * seq[: len(seq) - o + 1]
            key = mix(key)
            self.keys.append(key)
            self.place.append(within >= o - 1)

    def ngrams(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """Distinct words, and distinct longer n-grams: for each their names in order, and by length, at each place, the number of that which ends there (-1: none)."""
        return [self._numbered(self.keys[:1], self.place[:1]), self._numbered(self.keys[1:], self.place[1:])]

    @staticmethod
    def _numbered(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        names, inverse = np.unique(np.concatenate([np.zeros(0, U64), *(k[p] for k, p in zip(keys, place))]), return_inverse=True)
        out, a = [], 0
        for p in place:
            n = np.full(len(p), -1, dtype=np.int64)
            z = a + int(p.sum())
            n[p] = inverse[a:z]
            out.append(n)
            a = z
        return names, out


_PARTS = "range int, block long, words binary, word_n binary, ngrams binary, ngram_n binary"


def _parts(batches: Iterator[pa.RecordBatch], ranges: int, order: int) -> Iterator[pa.RecordBatch]:
    """Each block's words and longer n-grams with their number in its training texts, cut into ranges; a row for every range."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            b = Block(row, order)
            training = np.repeat(~b.held, b.lengths + 1)
            columns: list[list] = []
            for names, at in b.ngrams():
                n = np.bincount(np.concatenate([np.zeros(0, np.int64), *(x[training & (x >= 0)] for x in at)]), minlength=len(names))
                cut = bounds(names, ranges)
                columns += [[_runs(names[a:z]) for a, z in zip(cut[:-1], cut[1:])], [packed(n[a:z], "<u4") for a, z in zip(cut[:-1], cut[1:])]]
            release()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), pa.array([row["block"]] * ranges, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["range", "block", "words", "word_n", "ngrams", "ngram_n"])


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Answers of a range (block, word_n, ngram_n, v): the counts over all blocks of each block's own, and how many words training has here."""

    def over_all(names: pd.Series, counts: pd.Series) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        lists = [_from_runs(x) for x in names]
        u, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([unpacked(x, "<u4") for x in counts]), minlength=len(u)).astype(np.int64)
        own = np.split(n[inverse], np.cumsum([len(x) for x in lists])[:-1])
        return u, n, [packed(x, "<i8") for x in own]

    u, n, word_n = over_all(rows["words"], rows["word_n"])
    v = int(((n > 0) & (u != mix(np.array([START]))[0])).sum())
    ngram_n = over_all(rows["ngrams"], rows["ngram_n"])[2]
    release()
    return pd.DataFrame({"range": key[0], "block": rows["block"], "word_n": word_n, "ngram_n": ngram_n, "v": v})


class Automaton:
    """The part of the automaton that a block's texts meet, by places.

    counts[o - 1]: of the n-gram of o words that ends at a place (-1: none);
    contexts[o - 1]: of the state of o - 1 words before the place.
    """

    def __init__(self, counts: list[np.ndarray], n_all: int, v_all: int, strength: float):
        self.counts, self.strength = counts, strength
        self.contexts = [None, *(np.concatenate([[-1], c[:-1]]) for c in counts[:-1])]
        self.arcs = [(np.maximum(counts[0], 0) + 0.5) / (n_all + 0.5 * (v_all + 1))]
        for o in range(1, len(counts)):
            state = (self.contexts[o] > 0) & (counts[o] >= 0)
            p = (np.maximum(counts[o], 0) + strength * self.arcs[-1]) / (np.maximum(self.contexts[o], 0) + strength)
            self.arcs.append(np.where(state, p, self.arcs[-1]))

    def walk(self) -> np.ndarray:
        """Log10 weight of each place's step from left to right.

        The state before a place is the longest context seen in training, which
        the counts of the n-grams that end at the place before tell: all texts
        carry their states along at once.
        """
        out, walking = np.zeros(len(self.arcs[0])), np.ones(len(self.arcs[0]), dtype=bool)
        for o in range(len(self.counts) - 1, 0, -1):
            inside = walking & (self.contexts[o] > 0) & (self.counts[o] >= 0)
            arc = inside & (self.counts[o] > 0)
            out[arc] += np.log10(self.arcs[o][arc])
            walking[arc] = False
            lost = inside & ~arc  # the failure arc to the shorter context
            out[lost] += np.log10(self.strength / (self.contexts[o][lost] + self.strength))
        out[walking] += np.log10(self.arcs[0][walking])
        return out


def _score(block: pd.DataFrame, answers: pd.DataFrame, n_all: int, order: int, strength: float) -> pd.DataFrame:
    b = Block(block.iloc[0].to_dict(), order)
    answers, counts = answers.sort_values("range"), []
    for (_, at), column in zip(b.ngrams(), ("word_n", "ngram_n")):
        n = np.concatenate([np.zeros(0, np.int64), *(unpacked(x, "<i8") for x in answers[column])])
        counts += [np.where(x >= 0, n[x], -1) if len(n) else x for x in at]
    v_all = int(answers["v"].sum())  # every range answers every block
    a = Automaton(counts, n_all, v_all, strength)
    add = lambda x: np.add.reduceat(np.where(b.word, x, 0), b.first)
    out = pd.DataFrame({"doc_id": b.docs, "held_out": b.held, "n_tokens": b.lengths, "n_known": add((counts[0] > 0).astype(np.int64)), "train_tokens": n_all, "base_score": add(np.log10(a.arcs[0])), "score": add(a.walk())})
    release()
    return out


def score_texts(docs: DataFrame, held_out, order: int = ORDER, strength: float = STRENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs(doc_id, text).

    Rows for which the Column `held_out` is true are scored but not learned
    from.  A null text is empty and has its end token alone; a null doc_id is
    learned from and comes back as null with held_out false; rows may repeat; no
    rows give no rows.  Columns other than doc_id and text are read only by
    `held_out`.
    """
    small_batches(docs)
    nothing = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(nothing)).alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    many = max(1, int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (6 * block_tokens))
    blocks = bucketed(rows.mapInArrow(lambda it: _blocks(it, block_tokens), "block long, words binary, tokens binary, docs binary, lengths binary, held binary, size long, train long"), "block", many, "blocks")
    sizes = blocks.agg(F.sum("size").alias("all"), F.sum("train").alias("train")).first()
    n_all, ranges = int(sizes["train"] or 0), max(1, -(-order * int(sizes["all"] or 0) // RANGE_NGRAMS))
    # One block a batch: a block's n-grams fill a good part of a task's memory.
    texts = blocks.select("block", "words", "tokens", "docs", "lengths", "held")
    parts = texts.mapInArrow(lambda it: _parts((b.slice(i, 1) for b in it for i in range(b.num_rows)), ranges, order), _PARTS)
    answers = parts.groupBy("range").applyInPandas(_summed, "range int, block long, word_n binary, ngram_n binary, v long")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda a, b: _score(a, b, n_all, order, strength), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.when(F.col("doc_id") != nothing, F.col("doc_id")))
