"""How far the sources of a language lie apart in their use of terms.

Counts are gathered in tasks before they are shuffled.  The distance of two
sources is a sum over all kept terms, of which a source uses few; so sources
are rows of a sparse matrix, and each row scatters its terms through the
term-major index of a block of terms into a dense accumulator over its peers.
What a row owes to terms that only one of both uses, or none, is a correction
by the sources' baselines and needs no entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planarium.llm._store import small_batches, written
from planarium.llm._text import LOWER, release, slices, utf8, words
from planarium.llm.pieces import spans

#: Entries that a task gathers before it hands them on, and entries of a block of terms (as many as it has accumulators, if those are more).
HELD, BLOCK_ENTRIES = 1_000_000, 1 << 17
#: Every term gets this many occurrences more; shares are counted in units of 1 / SCALE.
SMOOTH, SCALE = 5, 1_000_000_000

#: Bytes that are no part of a term: all of ASCII but letters.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[:0x80] = True
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B)):
    SEPARATOR[_a:_b] = False

_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(batch: pa.RecordBatch) -> pa.Table:
    """Rows (lang, source, term, n, docs) of a few texts, each term of a group once."""
    buf, offsets = utf8(batch.column("text"))
    buf = LOWER[buf]
    starts, ends, first = words(buf, offsets, SEPARATOR)
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    term = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buf[~SEPARATOR[buf]])]).dictionary_encode()
    code = term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
    seen = list(dict.fromkeys(zip(groups.field("lang").to_pylist(), groups.field("source").to_pylist())))
    number = {g: i for i, g in enumerate(seen)}
    group = np.array([number[g] for g in zip(groups.field("lang").to_pylist(), groups.field("source").to_pylist())], dtype=np.int64)
    wide = max(len(term.dictionary), 1)
    pair, n = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(first)) * wide + code, return_counts=True)
    key, at, docs = np.unique(group[pair // wide] * wide + pair % wide, return_inverse=True, return_counts=True)
    of = key // wide
    return pa.table({
        "lang": pa.array([g[0] for g in seen], pa.string()).take(pa.array(of)), "source": pa.array([g[1] for g in seen], pa.string()).take(pa.array(of)),
        "term": term.dictionary.cast(pa.string()).take(pa.array(key % wide)), "n": np.bincount(at, weights=n, minlength=len(key)).astype(np.int64), "docs": docs.astype(np.int64),
    })


def _gathered(batches):
    """Counts of a task's texts, summed before they leave it."""
    held, entries = [], 0

    def out():
        table = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        table = table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    for b in slices(batches):
        held.append(_terms(b))
        entries += held[-1].num_rows
        if entries >= 3 * HELD:
            yield from out()
            held, entries = [], 0
            release()
    if held:
        yield from out()


def kept_terms(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """Rows (lang, source, term, n): occurrences of each term that at least `least_docs` documents of the language have."""
    counts = docs.mapInArrow(_gathered, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("known", known).where(F.col("known") >= least_docs).select("lang", "source", "term", "n")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exactly; 0 without terms."""
    over = F.nullif(total + SMOOTH * terms, F.lit(0).cast("long")).cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    return F.coalesce(1 + F.call_function("div", top, over), F.lit(0).cast("long"))


def _accumulate(key: tuple, entries: pa.Table, peers: pa.Table) -> pa.Table:
    """Rows (g, own, base) of a block of terms: for each of its sources dense sums over all sources of the language.

    base[h]: sum over the row's terms of |p - baseline of h|.  own[h]: base[h],
    and for terms that h has too what replaces both baselines.  The float sums
    of bincount are whole numbers below 2^53: each stays below 4 * (SCALE + terms).
    """
    if not entries.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), "g": pa.array([], pa.int32()), "own": pa.array([], pa.list_(pa.int64())), "base": pa.array([], pa.list_(pa.int64()))})
    floor = np.array(peers.column("bases")[0].as_py(), dtype=np.int64)
    g, p = entries.column("g").to_numpy().astype(np.int64), entries.column("p").to_numpy()
    term = entries.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # The term-major index: entries by term; a row looks its terms' stretches up there.
    by_term = np.argsort(term, kind="stable")
    g_t, p_t = g[by_term], p[by_term]
    edge = np.concatenate([[0], np.cumsum(np.bincount(term))])
    by_row = np.argsort(g, kind="stable")
    rows, begin = np.unique(g[by_row], return_index=True)
    out_g, own, base = [], [], []
    for r, a, b in zip(rows.tolist(), begin.tolist(), np.append(begin[1:], len(g)).tolist()):
        t, mine = term[by_row[a:b]], p[by_row[a:b]]
        order = np.sort(mine)
        upto = np.concatenate([[0], np.cumsum(order)])
        k = np.searchsorted(order, floor, side="right")
        against = floor * k - upto[k] + (upto[-1] - upto[k]) - floor * (len(order) - k)
        acc = np.zeros(len(floor))
        long = edge[t + 1] - edge[t]
        cuts = np.append(np.arange(0, len(t), 4096), len(t))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # a few thousand terms at once
            at = spans(edge[t[x:y]], long[x:y])
            peer, theirs, here = g_t[at], p_t[at], np.repeat(mine[x:y], long[x:y])
            acc += np.bincount(peer, weights=np.abs(here - theirs) - np.abs(here - floor[peer]) - np.abs(floor[r] - theirs) + np.abs(floor[r] - floor[peer]), minlength=len(floor))
        out_g.append(r)
        own.append(against + acc.astype(np.int64))
        base.append(against)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(out_g), pa.string()), "g": pa.array(out_g, pa.int32()), "own": pa.array(own, pa.list_(pa.int64())), "base": pa.array(base, pa.list_(pa.int64()))})


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part `pair`: every other source of the language by distance, farthest
    first.  Part `term`: up to `top` kept terms that the source uses more than
    its language.  Null text, lang or source counts as ''; sources without any
    term take part; equal values are ordered by item; no documents give no
    rows.  Columns other than text, lang and source are ignored.  A language's
    list of sources goes to each of its blocks: the result has a row for each
    pair of them anyway.
    """
    small_batches(docs)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = written(kept_terms(docs, least_docs), "kept")
    of_lang = written(kept.groupBy("lang", "term").agg(F.sum("n").alias("n_lang")), "terms")
    langs = of_lang.groupBy("lang").agg(F.sum("n_lang").alias("lang_total"), F.count("*").alias("terms"))
    wide = kept.groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("s"))
    blocks = wide.select("lang", F.ceil(F.col("n") / F.greatest(F.lit(block_entries), F.col("s") * F.col("s"))).cast("int").alias("blocks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    sources = docs.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms")), ["lang", "source"], "left")
    sources = sources.join(langs, "lang", "left").join(blocks, "lang", "left").select("lang", "source", zero("total"), zero("own_terms"), zero("lang_total"), zero("terms"), F.coalesce("blocks", F.lit(0)).alias("blocks"))
    sources = sources.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("base", share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    sources = written(sources, "sources")
    entries = kept.join(sources, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    q = share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    more = entries.join(of_lang, ["lang", "term"]).select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
    by = lambda *last: Window.partitionBy("lang", "source").orderBy(F.desc("value"), *last)
    terms = more.withColumn("rank", F.row_number().over(by("item"))).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # Blocks of terms with all entries of a term together, and the baselines of the language's sources.
    dealt = entries.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "g", "term", "p")
    all_of = sources.groupBy("lang", "blocks").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "base", "own_terms"))), lambda s: s["base"]).alias("bases"), F.transform(F.array_sort(F.collect_list(F.struct("g", "own_terms"))), lambda s: s["own_terms"]).alias("owns"))
    all_of = written(all_of, "baselines")
    to_blocks = all_of.where("blocks > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "bases")
    rows = dealt.groupBy("lang", "block").cogroup(to_blocks.groupBy("lang", "block")).applyInArrow(_accumulate, "lang string, g int, own array<long>, base array<long>")
    met = rows.select("lang", "g", F.posexplode(F.arrays_zip("own", "base")).alias("h", "v"))
    met = met.select("lang", F.explode(F.array(F.struct("g", "h", F.col("v.own").alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("v.base").alias("value")))).alias("x")).select("lang", "x.*")
    # Every row's accumulator begins with what all terms unknown to both sources give.
    start = sources.join(all_of.select("lang", "bases", "owns"), "lang").select("lang", "g", "terms", "base", "own_terms", F.posexplode(F.arrays_zip("bases", "owns")).alias("h", "v"))
    start = start.select("lang", "g", "h", ((F.col("terms") - F.col("own_terms") - F.col("v.owns")) * F.abs(F.col("base") - F.col("v.bases"))).alias("value"))
    sums = start.unionByName(met).groupBy("lang", "g", "h").agg(F.sum("value").alias("value")).where("g <> h")
    name = lambda c, as_: sources.select("lang", F.col("g").alias(c), F.col("source").alias(as_))
    pairs = sums.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"]).select("lang", "source", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by("item"))).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
