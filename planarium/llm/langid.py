"""Language identification in two steps: family first, then the language within it.

Texts become square-root counts of hashed letter trigrams.  A linear support
vector machine for each pair of families votes for the family; a machine for
each pair of languages of that family votes for the language.  The machines
are trained side by side, one Spark task a pair, each on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from planarium.llm._store import small_batches, written
from planarium.llm._text import slices, utf8

#: Hashed trigrams.
DIMENSIONS = 1 << 13
#: Labelled documents of either side that a machine is trained on (about); a family's are shared among its languages.
SAMPLE = 800

# Families of languages.
FAMILY = {
    **dict.fromkeys("de en nl sv da no nb nn is fy af lb yi".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca gl oc la ast".split(), "romance"),
    **dict.fromkeys("ru uk be pl cs sk bg mk sr hr bs sl".split(), "slavic"),
    **dict.fromkeys("fi et hu".split(), "uralic"),
    **dict.fromkeys("lt lv".split(), "baltic"),
    **dict.fromkeys("hi bn ur pa gu mr ne si".split(), "indic"),
    **dict.fromkeys("tr az kk uz ky tk".split(), "turkic"),
    **dict.fromkeys("ar he mt".split(), "semitic"),
    **dict.fromkeys("ga gd cy br".split(), "celtic"),
}

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def family(lang: str) -> str:
    """The family of a language; one that is not listed is a family of its own."""
    return FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Normalised rows for stretches of the texts: (index of the first, matrix)."""
    buf, offsets = utf8(column)
    x = _LETTERS[buf].astype(np.uint32)
    code = np.zeros(len(x), dtype=np.uint32)
    if len(x) > 2:
        code[:-2] = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(19)
        blank = (x[:-2] == 0x20) & (x[1:-1] == 0x20)
        code[:-2][blank] = DIMENSIONS
    for back in (1, 2):  # no trigram reaches into the next text
        at = offsets[1:] - back
        code[at[at >= 0]] = DIMENSIONS
    n, width = len(offsets) - 1, DIMENSIONS + 1
    for a in range(0, n, 64):
        b = min(a + 64, n)
        part = code[offsets[a] : offsets[b]].astype(np.int64)
        part += np.repeat(np.arange(b - a) * width, np.diff(offsets[a : b + 1]))
        m = np.sqrt(np.bincount(part, minlength=(b - a) * width).reshape(b - a, width)[:, :DIMENSIONS].astype(np.float32))
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        yield a, m


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of a linear support vector machine by dual coordinate descent; y is +1 or -1."""
    w = np.zeros(x.shape[1] + 1)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    alpha, q = np.zeros(len(x)), (x * x).sum(axis=1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _train_pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("h")
    x = np.vstack([m for _, m in features(pa.array(rows["text"], pa.string()))])
    y = np.where(rows["side"].to_numpy() == key[1], 1.0, -1.0)
    return pd.DataFrame({"level": [key[0]], "a": [key[1]], "b": [key[2]], "w": [train_svm(x, y)]})


class Hierarchy:
    """Machines by level: ('', family, family) and (family, language, language)."""

    def __init__(self, languages: list[str], machines: dict[tuple[str, str, str], np.ndarray]):
        self.members: dict[str, list[str]] = {}
        for x in sorted(languages):
            self.members.setdefault(family(x), []).append(x)
        self.machines = machines

    def _choose(self, m: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with the most votes for each row (ties: the larger sum of margins), and its confidence."""
        votes, margins = np.zeros((len(m), len(names))), np.zeros((len(m), len(names)))
        sure = np.full((len(m), len(names)), np.inf)
        for i, j in combinations(range(len(names)), 2):
            w = self.machines.get((level, names[i], names[j]))
            d = m @ w[:-1].astype(np.float32) + w[-1] if w is not None else np.zeros(len(m))
            votes[:, i] += d > 0
            votes[:, j] += d <= 0
            margins[:, i] += d
            margins[:, j] -= d
            sure[:, i] = np.minimum(sure[:, i], d)
            sure[:, j] = np.minimum(sure[:, j], -d)
        best = (votes + 1e-3 * np.tanh(margins)).argmax(axis=1)
        return best, 1 / (1 + np.exp(-4 * np.clip(sure[np.arange(len(m)), best], -9, 9)))

    def predict(self, m: np.ndarray) -> tuple[list[str], np.ndarray]:
        groups = sorted(self.members)
        top, score = self._choose(m, "", groups)
        out = np.empty(len(m), dtype=object)
        for k, name in enumerate(groups):
            rows = np.flatnonzero(top == k)
            if len(rows):
                best, inner = self._choose(m[rows], name, self.members[name])
                out[rows] = np.array(self.members[name], dtype=object)[best]
                score[rows] *= inner
        return out.tolist(), score


def train_hierarchy(labelled: DataFrame, sample: int = SAMPLE) -> Hierarchy:
    """Learn from labelled(doc_id, text, lang); rows without text or lang teach nothing.

    Every language is learned.  Each machine sees about `sample` documents of
    either side, chosen by a hash of doc_id (of the text where that is null).
    """
    small_batches(labelled)
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Hierarchy(list(counts), {})
    spark = labelled.sparkSession
    rates = F.broadcast(spark.createDataFrame([(k, family(k), min(1.0, sample / n)) for k, n in sorted(counts.items())], "lang string, family string, rate double"))
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "text")))
    part = F.pmod("h", F.lit(1_000_000)) / 1e6
    chosen = written(labelled.select("lang", "text", h.alias("h")).join(rates, "lang").where(part < F.col("rate")), "langid")
    groups: dict[str, list[str]] = {}
    for x in sorted(counts):
        groups.setdefault(family(x), []).append(x)
    tasks = [("", a, b) for a, b in combinations(sorted(groups), 2)] + [(g, a, b) for g, names in groups.items() for a, b in combinations(names, 2)]
    pairs = F.broadcast(spark.createDataFrame([(level, a, b, side, 1.0 if level else 1.0 / len(groups[side])) for level, a, b in tasks for side in (a, b)], "level string, a string, b string, side string, share double"))
    side = ((F.col("level") == "") & (F.col("side") == F.col("family"))) | ((F.col("level") == F.col("family")) & (F.col("side") == F.col("lang")))
    rows = chosen.join(pairs, side & (part < F.col("rate") * F.col("share"))).select("level", "a", "b", "side", "text", "h")
    models = rows.groupBy("level", "a", "b").applyInPandas(_train_pair, "level string, a string, b string, w array<double>")
    return Hierarchy(list(counts), {(r["level"], r["a"], r["b"]): np.array(r["w"]) for r in models.collect()})


def _label(batches: Iterator[pa.RecordBatch], model: Hierarchy, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        column = batch.column("text")
        worded = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        langs: list[str] = []
        scores: list[np.ndarray] = []
        for _, m in features(column):
            if model.members:
                got, score = model.predict(m)
            else:
                got, score = ["und"] * len(m), np.zeros(len(m))
            langs += got
            scores.append(score)
        score = np.where(worded, np.concatenate(scores) if scores else 0.0, 0.0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x if ok else "und" for x, ok in zip(langs, worded.tolist())], pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names])


def with_language(docs: DataFrame, model: Hierarchy, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score beside all its columns; columns of these two names are replaced."""
    small_batches(docs)
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(pred, score)
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return docs.mapInArrow(lambda it: _label(it, model_.value, [pred, score]), schema)


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each row of docs(doc_id, text).

    The whole text decides, and nothing else.  A text that is null or has no
    letter is `und` with score 0, as is every text if nothing was learned; with
    one language learned, that one is given.  doc_id may be null or repeat; no
    rows give no rows.  Columns other than doc_id and text are not read.
    """
    return with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "lang_pred", "score")
