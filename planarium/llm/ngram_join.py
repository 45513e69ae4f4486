"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles; equal sets are one class,
and classes are joined.  All sets share one order of shingles, rare ones
first.  A set of n shingles needs a partner with at least c = ceil(t n) of
them, so two similar sets share l or more of their first n - c + l shingles,
whatever l.  That is used three times:

1. Screening.  Of each set, the first n - c + l shingles by hash are counted
   over all documents, with l an eighth of c.  A set of which fewer than l were
   met elsewhere is linked with nothing and needs no further work.
2. The whole sets of what is left are counted again.  Shingles of one set alone
   can't be shared; a set with fewer than c others is linked with nothing.
3. Adaptive prefixes.  From the counts, the number of candidates that a set's
   prefix will meet is known.  Where it is high, l is raised: the prefix is
   longer, and a pair is verified only if it shares as many of its shingles as
   the smaller l of both asks for.  The positions of a shared shingle bound
   what can follow, so rows that can't be one of the first l matches are left
   out of the count.

Groups of near copies are joined first through leading members, so that they
cost a few pairs a member; the multi-match join then meets only members of
different components.  A shingle's list is never sorted or held as a whole:
leaders are grouped minima, and long lists are joined in salted parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planarium.llm._pack import ascending, bounds, from_ascending, packed, summed, unpacked
from planarium.llm._store import components, small_batches, written
from planarium.llm._text import U64, mix, release, shingle_sets, slices

#: Shingles that one task packs into a block, and those that one range of the hash space sums (about).
BLOCK, RANGE = 1_500_000, 750_000
#: Ids of documents that may be broadcast to find their texts; beyond it, texts are joined by shuffle.
BROADCAST_IDS = 500_000
#: Candidates of a prefix beyond which l grows by one for each doubling, and the largest l.
COST, MOST = 256, 4
#: Pairs of one list that one key of the multi-match join compares.
SALTED = 1_000_000


def wanted(n: np.ndarray, threshold: int) -> np.ndarray:
    """Shingles that a partner must share at least."""
    return -(-threshold * n // 100)


def _blocks(batches: Iterator[pa.RecordBatch], threshold: int, width: int, eighths: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sets: keys of the rows, sizes, signatures, and the first shingles of each set by hash."""
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    held: list[tuple] = []

    def close():
        nonlocal held, seq, size
        key, th, n, s1, s2, least, tokens = (np.concatenate([h[i] for h in held]) for i in range(7))
        row = {"block": [part << 32 | seq], "key": [packed(key, "<i8")], "th": [packed(th, "<i8")], "n": [packed(n, "<u4")], "s1": [packed(s1, "<u8")], "s2": [packed(s2, "<u8")], "least": [packed(least, "<u4")], "tokens": [ascending(tokens)]}
        held, seq, size = [], seq + 1, 0
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in list(row)[1:])]))

    for batch in slices(batches):
        sets = shingle_sets(batch.column("text"), width)
        n = np.array([len(s) for s in sets], dtype=np.int64)
        need = wanted(n, threshold)
        least = -(-need * eighths // 8)
        with np.errstate(over="ignore"):
            s1, s2 = np.array([s.sum(dtype=U64) for s in sets], dtype=U64), np.array([mix(s ^ U64(0x5DEECE66D)).sum(dtype=U64) for s in sets], dtype=U64)
        tokens = np.concatenate([s[:k] for s, k in zip(sets, (n - need + least).tolist())])
        held.append((*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "th")), n, s1, s2, least, tokens))
        size += len(tokens)
        if size >= BLOCK:
            yield close()
    if held:
        yield close()


def _vocabularies(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each block with the number of its sets that hold them, cut into ranges."""
    for batch in batches:
        for b, tokens in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist()):
            words, n = np.unique(from_ascending(tokens), return_counts=True)
            at = bounds(words, ranges)
            rows = [(r, b, ascending(words[at[r] : at[r + 1]]), packed(n[at[r] : at[r + 1]], "<u4")) for r in np.flatnonzero(np.diff(at)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "block", "words", "n"])
    release()


def _counted(block: pd.DataFrame, answers: pd.DataFrame, threshold: int, whole: bool) -> pd.DataFrame:
    """Rows of a block with `open`: enough of the set's shingles are met elsewhere; with `whole`, those shingles and l."""
    schema = ["key", "th", "n", "s1", "s2", "open"] if not whole else ["key", "n", "l", "kept"]
    if not len(block):
        return pd.DataFrame(columns=schema)
    row = block.iloc[0]
    key, th, n, least = (unpacked(row[c], k) for c, k in (("key", "<i8"), ("th", "<i8"), ("n", "<u4"), ("least", "<u4")))
    n, least = n.astype(np.int64), least.astype(np.int64)
    taken = n - wanted(n, threshold) + least
    tokens, doc = from_ascending(row["tokens"]), np.repeat(np.arange(len(n)), taken)
    _, inverse = np.unique(tokens, return_inverse=True)
    df = np.concatenate([unpacked(x, "<i8") for x in answers.sort_values("range")["n"]] or [np.zeros(0, np.int64)])[inverse]
    met = df > 1
    open_ = (np.bincount(doc[met], minlength=len(n)) >= least) & (n > 0)
    if not whole:
        s1, s2 = (unpacked(row[c], "<u8").view(np.int64) for c in ("s1", "s2"))
        return pd.DataFrame({"key": key, "th": th, "n": n, "s1": s1, "s2": s2, "open": open_})
    met &= open_[doc]
    tokens, df, doc = tokens[met], df[met], doc[met]
    order = np.lexsort((tokens, df, doc))
    tokens, df, doc = tokens[order], df[order], doc[order]
    m = np.bincount(doc, minlength=len(n))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(n - m, m)
    first = at <= (n - wanted(n, threshold))[doc]
    cost = np.bincount(doc[first], weights=df[first] - 1, minlength=len(n))
    l = np.clip(1 + np.log2(1 + cost / COST).astype(np.int64), 1, np.minimum(MOST, np.maximum(wanted(n, threshold), 1)))
    sets = np.split(tokens.view(np.int64), np.cumsum(m)[:-1])
    release()
    return pd.DataFrame({"key": key[open_], "n": n[open_], "l": l[open_], "kept": pd.Series([sets[i] for i in np.flatnonzero(open_)], dtype=object)})


def _screened(texts: DataFrame, threshold: int, width: int, eighths: int) -> DataFrame:
    """texts(key, th, text) after counting the first shingles of all sets over all rows."""
    whole = eighths == 8
    names = ("key", "th", "n", "s1", "s2", "least", "tokens")
    blocks = written(texts.mapInArrow(lambda it: _blocks(it, threshold, width, eighths), "block long, " + ", ".join(f"{c} binary" for c in names)), "blocks")
    size = blocks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    # The first shingles by hash lie in the lower part of the hash space.
    ranges = max(1, -(-int(size) // (6 * RANGE)) * (1 if whole else 3))
    parts = blocks.select("block", "tokens").mapInArrow(lambda it: _vocabularies(it, ranges), "range int, block long, words binary, n binary")
    answers = parts.groupBy("range").applyInPandas(summed, "range int, block long, n binary")
    schema = "key long, n long, l int, kept array<long>" if whole else "key long, th long, n long, s1 long, s2 long, open boolean"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda a, b: _counted(a, b, threshold, whole), schema)


def _placed(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Postings of shingles whose sets are in several components, with the set's component c and the list's main one."""
    rows = postings.join(found.select(F.col("node").alias("d"), "root"), "d", "left").select(*postings.columns, F.coalesce("root", "d").alias("c"))
    sizes = rows.groupBy("h", "c").agg(F.count("*").alias("k"))
    mains = sizes.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("k_main"), F.sum("k").alias("k_all"), F.count("*").alias("parts"))
    return written(rows.join(mains.where("parts > 1").drop("parts"), "h"), "placed")


def _linked(nodes: DataFrame, threshold: int) -> DataFrame:
    """Rows (node, root): components of the sets (d, n, l, kept)."""
    t = F.lit(threshold)
    up = lambda top, base: F.floor((top + base - 1) / base)
    least = up(t * F.col("n"), F.lit(100))
    rare = F.col("n") - F.size("kept")
    taken = F.greatest(F.lit(0), (F.col("n") - least + F.col("l") - rare).cast("int"))
    postings = nodes.select("d", "n", "l", rare.alias("u"), (F.col("n") - least).alias("last"), F.posexplode(F.slice("kept", F.lit(1), taken)).alias("pos", "h"))
    postings = written(postings.select("h", "d", "n", "l", "pos", (F.col("pos") + F.col("u")).alias("at"), "last"), "postings")
    firsts = postings.where(F.col("at") <= F.col("last")).select("h", "d", "n", "at")

    def shared(a: Column, b: Column) -> Column:
        """Shingles that sets of these sizes must share."""
        return up(t * (a + b), F.lit(100 + threshold))

    #: Could this be the first shared shingle of two similar sets? Enough must be left after it in both.
    near = F.least(F.col("n") - F.col("at"), F.col("y.n") - F.col("y.at")) >= shared(F.col("n"), F.col("y.n"))
    tried: list[DataFrame] = []

    def links(pairs: DataFrame) -> DataFrame:
        """Similar sets among pairs (a, b), each pair looked at once in all rounds."""
        pairs = pairs.distinct()
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tried.append(pairs)
        side = lambda c: nodes.select(F.col("d").alias(c), F.col("n").alias(f"n_{c}"), F.col("kept").alias(f"kept_{c}"))
        common = F.size(F.array_intersect("kept_a", "kept_b"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(common >= shared(F.col("n_a"), F.col("n_b"))).select("a", "b")

    def met(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("d", "y.d").alias("a"), F.greatest("d", "y.d").alias("b"))

    # Each set with one set of each list, another one in each list.
    leaders = firsts.groupBy("h").agg(F.min_by(F.struct("d", "n", "at"), F.xxhash64("h", "d")).alias("y"), F.count("*").alias("k")).where("k > 1").drop("k")
    found = written(components(links(met(firsts.join(leaders, "h").where((F.col("d") != F.col("y.d")) & near)))), "roots")

    # In lists of several components, the other members with more and more members of the main one.
    leading, longest = 8, 9
    while leading < 16 * longest:
        open_ = _placed(firsts, found)
        longest = open_.agg(F.max("k_main")).first()[0]
        if longest is None:
            break
        leaders = open_.where("c = main").groupBy("h", F.pmod(F.xxhash64("d", "h"), F.lit(leading)).alias("slot")).agg(F.min_by(F.struct("d", "n", "at"), "d").alias("y"))
        rows = open_.where("c <> main").join(leaders, "h").where(near)
        found = written(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links(met(rows)))), "roots")
        leading *= 16

    # Multi-match join of all that is still in different components: pairs with l shared shingles among their prefixes.
    open_ = _placed(postings, found)
    parts = F.greatest(F.lit(1), F.ceil((F.col("k_all") - F.col("k_main")) * F.col("k_all") / SALTED)).cast("int")
    one = open_.where("c <> main").withColumn("part", F.pmod(F.hash("d"), parts))
    two = open_.select("h", F.struct("d", "n", "l", "pos", "at", "c", "main").alias("y"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    l = F.least("l", "y.l")
    early = F.least("pos", "y.pos", l - 1) + F.least(F.col("n") - F.col("at"), F.col("y.n") - F.col("y.at")) >= shared(F.col("n"), F.col("y.n"))
    once = (F.col("y.c") == F.col("y.main")) | (F.col("d") < F.col("y.d"))
    rows = one.join(two, ["h", "part"]).where((F.col("c") != F.col("y.c")) & once & early)
    counted = rows.groupBy(F.least("d", "y.d").alias("a"), F.greatest("d", "y.d").alias("b")).agg(F.count("*").alias("k"), F.first(l).alias("l"), F.max(F.least(F.col("n") - F.col("at"), F.col("y.n") - F.col("y.at"))).alias("rest"), F.first(shared(F.col("n"), F.col("y.n"))).alias("asked"))
    last = links(counted.where("k >= l and rest >= asked").select("a", "b"))
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(last))


def similar_groups(docs: DataFrame, threshold: int = 80, width: int = 5) -> DataFrame:
    """Rows (doc_id, text_hash, n_shingles, group), one for each row of docs(doc_id, text, ...).

    Rows whose sets are linked, directly or through others, have one group, a
    number without meaning of its own; it is null for an empty set.  Rows are
    told apart by doc_id and xxhash64 of the text only.
    """
    small_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    no_id = F.lit(-(1 << 63))
    rows = written(_screened(texts.select(F.coalesce("doc_id", no_id).alias("key"), "th", "text"), threshold, width, 1), "rows")
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.bool_or("open").alias("open"), F.min(F.struct("key", "th")).alias("rep"))
    classes = written(classes.withColumn("d", F.monotonically_increasing_id()), "classes")  # written at once, so numbers stay
    reps = written(classes.where("open").select("d", F.col("rep.key").alias("key"), F.col("rep.th").alias("th")), "candidates")
    if reps.count() <= BROADCAST_IDS:
        reps = F.broadcast(reps)
    again = texts.withColumn("key", F.coalesce("doc_id", no_id)).join(reps, ["key", "th"]).select(F.col("d").alias("key"), "th", "text")
    nodes = written(_screened(again, threshold, width, 8).dropDuplicates(["key"]).withColumnRenamed("key", "d"), "nodes")
    roots = _linked(nodes, threshold)
    placed = classes.join(roots.withColumnRenamed("node", "d"), "d", "left").select("s1", "s2", "n", F.coalesce("root", "d").alias("group"))
    return rows.join(placed, ["s1", "s2", "n"], "left").select(F.when(F.col("key") != no_id, F.col("key")).alias("doc_id"), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), "group")


def similar_components(docs: DataFrame, threshold: int = 80, width: int = 5) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for each row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links reach.  A null or blank text
    has an empty set and is linked with nothing; a text of fewer words than
    `width` has its whole word sequence as only shingle.  Several texts under
    one doc_id are one document with the links of all of them; a row without
    doc_id comes back with a null component and isn't anyone's component, but
    its text links others.  No rows give no rows.  Columns other than doc_id and
    text are not read.
    """
    rows = written(similar_groups(docs, threshold, width), "grouped")
    several = rows.where("doc_id is not null and group is not null").groupBy("doc_id").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.collect_set("group").alias("all")).where("a <> b")
    several = several.select("a", F.explode("all").alias("b")).where("a <> b")
    roots = components(several).select(F.col("node").alias("group"), "root")
    rows = rows.join(roots, "group", "left").withColumn("group", F.coalesce("root", "group"))
    first = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "group", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"))
