"""Passes that remove overlaps of equal labels after refinement.

A round changes only cells that are far enough apart not to see each other
change: a cell or pair moves if it is the worst among all that touch its
neighbourhood.  So a round is a plan of joins, and each move has the effect
that was computed for it.  Groups of cells that no neighbour joins don't see each
other at all, so all rounds of joint moves of small groups are made in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planarium.functions.ramps import posterior
from planarium.operators.calibrate import labelled
from planarium.operators.diagnostics import local_costs
from planarium.operators.graph import components
from planarium.sources.store import shuffled, written

#: Cells of a connected group whose rounds one task makes, and of groups that it takes together; edges whose forest is made at once.
GROUP_CELLS, TASK_CELLS, FOREST_EDGES = 50_000, 8192, 1_000_000
#: Joint options of pairs that are weighed at once.
MOST_OPTIONS = 1 << 20


def _worst_near(marks: DataFrame, nbrs: DataFrame) -> DataFrame:
    """Rows (cell_id, worst): the largest mark of a cell and its neighbours."""
    own = marks.select("cell_id", "m")
    near = nbrs.select("i", "j").join(shuffled(own).withColumnRenamed("cell_id", "j"), "j").select(F.col("i").alias("cell_id"), "m")
    return own.unionByName(near).groupBy("cell_id").agg(F.max("m").alias("worst"))


def _apply(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return written(labels.join(shuffled(moves).select("cell_id", F.col("label").alias("_new")), "cell_id", "left").withColumn("label", F.coalesce("_new", "label").cast("int")).drop("_new"), "labels")


def _supported(costs: str, k: Column, least: float) -> Column:
    """Does the posterior of label k reach `least`?"""
    return F.lit(True) if least <= 0 else F.get(posterior(F.col(costs)), k) >= least


def resolve_conflicts(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float, rounds: int = 20, boost: float = 5.0, boost_weight: float = 0.7, least: float = 0.01, use_frozen: bool = True, group_cells: int = GROUP_CELLS) -> tuple[DataFrame, int]:
    """Pairs of neighbours of one label move together to their best two labels; returns (labels, moves).

    First all pairs of positive weight, then, with lam times `boost`, those
    above `boost_weight`.  A move must lower the energy of the two; a cell
    that changes must have a posterior of at least `least` for its new label.
    With `use_frozen`, frozen cells keep their label.  Connected groups of at
    most `group_cells` cells are settled in a task, larger ones by rounds of joins.
    """
    labels, steps = written(labels, "labels"), ((lam, 0.0), (lam * boost, boost_weight)) if boost > 1 else ((lam, 0.0),)
    nbrs = written(nbrs.select("i", "j", F.coalesce("w", F.lit(0.0)).alias("w")), "nbrs")
    group = components(labels, _forest(nbrs))
    sizes = group.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    group = written(group.join(shuffled(sizes), "component").select("cell_id", "component", "n"), "groups")
    small = group.where(F.col("n") <= group_cells)
    blocks = max(1, -(-small.count() // TASK_CELLS))
    deal = lambda df: df.repartition(blocks, "block").groupBy("block")  # noqa: E731  # by number: a block is far more work than its bytes tell
    at = small.select("cell_id", F.pmod(F.xxhash64("component"), F.lit(blocks)).alias("block"))
    cells = labels.select("cell_id", F.col("label").cast("int").alias("label"), (F.col("frozen") if use_frozen else F.lit(False)).alias("frozen")).join(shuffled(at), "cell_id").join(shuffled(unary).select("cell_id", "costs"), "cell_id", "left")
    edges = nbrs.join(shuffled(at).withColumnRenamed("cell_id", "i"), "i").select("i", "j", "w", F.col("block").alias("block"))
    moved = written(deal(cells).cogroup(deal(edges)).applyInPandas(_joint_rounds(steps, rounds, least), "cell_id long, label int, moves long"), "moves")
    total = moved.agg(F.sum("moves")).first()[0] or 0
    after = _apply(labels, moved)
    large = group.where(F.col("n") > group_cells).select("cell_id")
    if large.isEmpty():
        return after, total
    # What groups of any size did is put together at the end.
    rest, nbrs = written(labels.join(shuffled(large), "cell_id", "left_semi"), "labels"), written(nbrs.join(shuffled(large).select(F.col("cell_id").alias("i")), "i", "left_semi"), "nbrs")
    for strength, weight in steps:
        for _ in range(rounds):
            moves = written(_joint_moves(rest, unary, nbrs, strength, weight, least, use_frozen), "moves")
            n = moves.count()
            if not n:
                break
            total += n
            rest = _apply(rest, moves.select(F.explode(F.array(F.struct(F.col("i").alias("cell_id"), F.col("k_i").alias("label")), F.struct(F.col("j").alias("cell_id"), F.col("k_j").alias("label")))).alias("x")).select("x.*"))
    return _apply(after, rest), total


def _forest(nbrs: DataFrame) -> DataFrame:
    """Edges (i, j) that join the same cells: of each stretch of cells that a task has, only those from a cell to the smallest that it reaches there."""
    edges = nbrs.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    edges = written(edges, "edges")

    def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n >= FOREST_EDGES:
                yield roots(pd.concat(held))
                held, n = [], 0
        if n:
            yield roots(pd.concat(held))

    def roots(rows: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(np.concatenate([rows["i"].to_numpy(), rows["j"].to_numpy()]), return_inverse=True)
        a, b, root = ends[: len(rows)], ends[len(rows) :], np.arange(len(ids))
        while len(a):
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
        other = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"i": ids[root[other]], "j": ids[other]})

    tasks = max(1, -(-edges.count() // FOREST_EDGES))
    return edges.repartitionByRange(tasks, "i").mapInPandas(few, "i long, j long")


def _joint_rounds(steps: tuple, rounds: int, least: float):
    """All rounds of whole groups in a task: rows (cell_id, label, moves) of the cells that moved, from cells (cell_id, label, frozen, costs) and edges (i, j, w).

    What a round does is what `_joint_moves` says; the moves of a task stand in one of its rows.
    """

    def settle(cells: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell_id")
        ids, known = cells["cell_id"].to_numpy(), cells["costs"].notna().to_numpy()
        label, frozen = cells["label"].fillna(-1).to_numpy().astype(int), cells["frozen"].eq(True).to_numpy()
        none = pd.DataFrame({"cell_id": ids[:0], "label": label[:0].astype(np.int32), "moves": ids[:0]})
        if not known.any() or not len(edges):
            return none
        k = max(len(c) for c in cells["costs"][known])
        costs = np.full((len(ids), k), np.inf)  # labels that a cell hasn't are never taken
        for at in np.flatnonzero(known).tolist():
            c = cells["costs"].iloc[at]
            costs[at, : len(c)] = c
        with np.errstate(invalid="ignore"):
            odds = np.exp(costs.min(axis=1, keepdims=True) - costs)
            odds /= odds.sum(axis=1, keepdims=True)
        edges = edges.sort_values(["i", "j", "w"])
        i, j, w = np.searchsorted(ids, edges["i"].to_numpy()), np.searchsorted(ids, edges["j"].to_numpy()), edges["w"].to_numpy()
        head = np.unique(i, return_index=True)
        ever, moves = np.zeros(len(ids), dtype=bool), 0
        for lam, weight in steps:
            mine = (i < j) & (w > weight) & known[i] & known[j]
            a, b, x = i[mine], j[mine], w[mine]
            rank = np.empty(len(a), dtype=int)
            rank[np.lexsort((b, a, x))] = np.arange(len(a))
            for _ in range(rounds):
                at = np.flatnonzero((label[a] == label[b]) & (label[a] >= 0) & (label[a] < k))
                near = label[j]
                put = (near >= 0) & (near < k)
                e = costs + lam * np.bincount(i[put] * k + near[put], w[put], len(ids) * k).reshape(-1, k)
                found, to = [], []
                for p in np.array_split(at, -(-len(at) * k * k // MOST_OPTIONS)) if len(at) else ():
                    row, own, push = np.arange(len(p)), label[a[p]], lam * x[p]
                    ea, eb = e[a[p]], e[b[p]]
                    ea[row, own] -= push
                    eb[row, own] -= push
                    now = ea[row, own] + eb[row, own] + push
                    for side, ends in ((ea, a[p]), (eb, b[p])):
                        still = np.flatnonzero(frozen[ends])
                        kept = side[still, own[still]].copy()
                        side[still] = np.inf
                        side[still, own[still]] = kept
                    options = ea[:, :, None] + eb[:, None, :]
                    options[:, np.arange(k), np.arange(k)] += push[:, None]
                    options = options.reshape(len(p), -1)
                    best = options.argmin(axis=1)
                    ok, ka, kb = options[row, best] < now - 1e-9, best // k, best % k
                    if least > 0:
                        ok &= ((ka == own) | (odds[a[p], ka] >= least)) & ((kb == own) | (odds[b[p], kb] >= least))
                    found.append(p[ok])
                    to.append(np.stack([ka[ok], kb[ok]], axis=1))
                if not sum(map(len, found)):
                    break
                found, to = np.concatenate(found), np.concatenate(to)
                mark = np.full(len(ids), -1)
                np.maximum.at(mark, a[found], rank[found])
                np.maximum.at(mark, b[found], rank[found])
                worst = mark.copy()
                worst[head[0]] = np.maximum(worst[head[0]], np.maximum.reduceat(mark[j], head[1]))
                go = (worst[a[found]] == rank[found]) & (worst[b[found]] == rank[found])
                found, to = found[go], to[go]
                label[a[found]], label[b[found]] = to[:, 0], to[:, 1]
                ever[a[found]] = ever[b[found]] = True
                moves += len(found)
        if not moves:
            return none
        return pd.DataFrame({"cell_id": ids[ever], "label": label[ever].astype(np.int32), "moves": np.where(np.arange(ever.sum()) == 0, moves, 0)})

    return settle


def _joint_moves(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float, weight: float, least: float, use_frozen: bool) -> DataFrame:
    pairs = labelled(nbrs.where((F.col("i") < F.col("j")) & (F.col("w") > weight)), labels).where("label_i = label_j and label_i >= 0").select("i", "j", "w", F.col("label_i").alias("k"))
    e = local_costs(labels, unary, nbrs, lam)
    side = lambda c: e.select(F.col("cell_id").alias(c), F.col("energies").alias(f"e_{c}"), F.col("costs").alias(f"u_{c}"), (F.col("frozen") if use_frozen else F.lit(False)).alias(f"f_{c}"))
    rows = pairs.join(shuffled(side("i")), "i").join(shuffled(side("j")), "j")
    # What the partner puts on the current label is counted once, as the pair's own cost.
    alone = lambda c: F.transform(f"e_{c}", lambda x, k: F.when(k == F.col("k"), x - lam * F.col("w")).otherwise(x))
    rows = rows.withColumn("a", alone("i")).withColumn("b", alone("j"))
    free = lambda c: F.when(F.col(f"f_{c}"), F.array(F.col("k"))).otherwise(F.sequence(F.lit(0), F.size("a") - 1))
    cross = lambda x, y: F.when(x == y, lam * F.col("w")).otherwise(0.0)
    options = F.flatten(F.transform(free("i"), lambda x: F.transform(free("j"), lambda y: F.struct((F.get("a", x) + F.get("b", y) + cross(x, y)).alias("e"), x.cast("int").alias("x"), y.cast("int").alias("y")))))
    now = F.get("a", F.col("k")) + F.get("b", F.col("k")) + lam * F.col("w")
    rows = rows.withColumn("best", F.explode(F.array(F.array_min(options)))).withColumn("now", now).where("best.e < now - 1e-9")
    rows = rows.where(((F.col("best.x") == F.col("k")) | _supported("u_i", F.col("best.x"), least)) & ((F.col("best.y") == F.col("k")) | _supported("u_j", F.col("best.y"), least)))
    mark = F.struct("w", "i", "j")
    rows = written(rows.select("i", "j", mark.alias("m"), F.col("best.x").alias("k_i"), F.col("best.y").alias("k_j")), "options")
    marks = rows.select(F.explode(F.array("i", "j")).alias("cell_id"), "m").groupBy("cell_id").agg(F.max("m").alias("m"))
    worst = _worst_near(marks, nbrs)
    w = lambda c: shuffled(worst).select(F.col("cell_id").alias(c), F.col("worst").alias(f"w_{c}"))
    return rows.join(w("i"), "i").join(w("j"), "j").where((F.col("m") == F.col("w_i")) & (F.col("m") == F.col("w_j"))).select("i", "j", "k_i", "k_j")


def clear_residuals(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, rounds: int = 20, least: float = 0.01) -> tuple[DataFrame, int, int]:
    """Cells that still overlap fellows of their label move to a label that no overlapping neighbour has; returns (labels, moved, unlabelled).

    Of several such labels the cheapest is taken; without any, or where its
    posterior is below `least` (unless all overlapping fellows are frozen), the
    cell becomes -1.  Frozen cells stay.
    """
    labels, moved, lost = written(labels, "labels"), 0, 0
    top = labels.agg(F.max("label")).first()[0]
    if top is None or top < 0:
        return labels, 0, 0
    near = nbrs.where("w > 0")
    for _ in range(rounds):
        l = labels.select(F.col("cell_id").alias("j"), F.col("label").alias("k"), F.col("frozen").alias("f")).where("k >= 0")
        met = near.join(shuffled(l), "j").join(shuffled(labels).select(F.col("cell_id").alias("i"), F.col("label").alias("own"), F.col("frozen").alias("still")), "i").where("own >= 0")
        by = met.groupBy("i").agg(F.sum(F.when(F.col("k") == F.col("own"), F.col("w")).otherwise(0.0)).alias("v"), F.collect_set("k").alias("taken"), F.bool_and(F.when(F.col("k") == F.col("own"), F.col("f"))).alias("all_frozen"), F.first("own").alias("own"), F.first("still").alias("still"))
        bad = by.where("v > 0 and not still").select(F.col("i").alias("cell_id"), "v", "taken", "all_frozen", "own")
        rows = bad.join(shuffled(unary), "cell_id").withColumn("m", F.struct("v", "cell_id"))
        options = F.transform(F.filter(F.sequence(F.lit(0), F.lit(top)), lambda k: ~F.array_contains("taken", k)), lambda k: F.struct(F.get("costs", k).alias("c"), k.cast("int").alias("k")))
        rows = rows.withColumn("best", F.explode(F.array(F.array_min(options))))
        ok = F.col("best").isNotNull() & (F.col("all_frozen") | _supported("costs", F.col("best.k"), least))
        rows = written(rows.select("cell_id", "m", F.when(ok, F.col("best.k")).otherwise(-1).alias("label")), "options")
        moves = written(rows.join(shuffled(_worst_near(rows, near)), "cell_id").where(F.col("m") == F.col("worst")).select("cell_id", "label"), "moves")
        n = moves.agg(F.count_if(F.col("label") >= 0).alias("a"), F.count_if(F.col("label") < 0).alias("b")).first()
        if not n["a"] + n["b"]:
            break
        moved, lost = moved + n["a"], lost + n["b"]
        labels = _apply(labels, moves)
    return labels, moved, lost
