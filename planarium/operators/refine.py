"""Label refinement by energy minimisation over a signed neighbour table.

nbrs (i, j, w) holds both directions; unary (cell_id, costs) an array of costs
by label; labels (cell_id, label) uses -1 for cells without a label.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.functions.ramps import argmin, ramp
from planarium.operators.calibrate import labelled
from planarium.operators.graph import both_ways, components
from planarium.sources.store import shuffled, written


def neighbours(pairs: DataFrame, low: float, high: float, kind=ramp) -> DataFrame:
    """nbrs from coverage pairs; weights of 0 are dropped."""
    return both_ways(pairs.select("i", "j", kind(F.col("cf"), low, high).alias("w")).where("w <> 0"))


def energy(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float) -> DataFrame:
    """One row (unary, pairwise, energy)."""
    u = labels.where("label >= 0").join(shuffled(unary), "cell_id").agg(F.coalesce(F.sum(F.get("costs", F.col("label"))), F.lit(0.0)).alias("unary"))
    p = labelled(nbrs.where("i < j"), labels).where("label_i = label_j and label_i >= 0").agg((lam * F.coalesce(F.sum("w"), F.lit(0.0))).alias("pairwise"))
    return u.join(p, F.lit(True)).withColumn("energy", F.col("unary") + F.col("pairwise"))  # one row with one row


def violations(pairs: DataFrame, labels: DataFrame, low: float, high: float) -> DataFrame:
    """Rows (label, n_violations, penalty) over pairs of equal label with a positive ramp."""
    p = labelled(pairs, labels).where("label_i = label_j and label_i >= 0").withColumn("w", ramp(F.col("cf"), low, high)).where("w > 0")
    return p.groupBy(F.col("label_i").alias("label")).agg(F.count("*").alias("n_violations"), F.sum("w").alias("penalty"))


def conflict_scores(nbrs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (cell_id, conflict): summed positive weights of neighbours with the same label."""
    p = labelled(nbrs, labels).where("label_i = label_j and w > 0 and label_i >= 0")
    return p.groupBy(F.col("i").alias("cell_id")).agg(F.sum("w").alias("conflict"))


def label_scores(nbrs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (cell_id, label, score): summed positive weights by the neighbours' label."""
    l = labels.select(F.col("cell_id").alias("j"), "label")
    return nbrs.where("w > 0").join(shuffled(l), "j").where("label >= 0").groupBy(F.col("i").alias("cell_id"), "label").agg(F.sum("w").alias("score"))


def jacobi_sweep(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float, digits: int = 9) -> DataFrame:
    """One synchronous sweep: every cell that isn't frozen takes the label of least local energy, the first on ties."""
    l = labels.select(F.col("cell_id").alias("j"), F.col("label").alias("k")).where("k >= 0")
    push = nbrs.join(shuffled(l), "j").groupBy(F.col("i").alias("cell_id"), "k").agg(F.sum("w").alias("w")).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("push"))
    cost = F.transform("costs", lambda c, k: F.round(c + lam * F.coalesce(F.try_element_at("push", k), F.lit(0.0)), digits))
    rows = labels.join(shuffled(unary), "cell_id").join(shuffled(push), "cell_id", "left")
    return rows.select("cell_id", F.when(F.col("frozen"), F.col("label")).otherwise(argmin(cost)).alias("label"), "frozen")


def icm_jacobi(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float, most: int = 20) -> DataFrame:
    """Sweeps until no label changes or `most` are done; each sweep is written."""
    for _ in range(most):
        after = written(jacobi_sweep(labels, unary, nbrs, lam), "sweep")
        changed = after.join(shuffled(labels).select("cell_id", F.col("label").alias("old")), "cell_id").where("label <> old").limit(1).count()
        labels = after
        if not changed:
            break
    return labels


def icm_settled(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float, most: int = 50) -> DataFrame:
    """Synchronous sweeps while each lowers the energy, then rounds of moves that can't harm each other; every round is written.

    Neighbours that move at once may each count on the other staying, so plain
    sweeps can swing between two labelings for ever.  A sweep that doesn't lower
    the energy is taken back; from then on a cell moves only if no neighbour
    that wants to move gains more (equal gains: the smaller id goes first), so
    every round lowers the energy by the sum of its gains and the end is a
    labeling that no single cell would leave.  Where plain sweeps come to rest
    with falling energy, the result is theirs.  Frozen cells keep their labels,
    cells of label -1 may take one, and no cells give no rows.
    """
    now, at_once = labels.select("cell_id", F.col("label").cast("int").alias("label"), "frozen"), True
    reached = energy(now, unary, nbrs, lam).first()["energy"]
    for _ in range(most):
        wish = written(wishes(now, unary, nbrs, lam), "wishes")
        if wish.where("wish <> label").isEmpty():
            break
        if at_once:
            after = wish.select("cell_id", F.col("wish").alias("label"), "frozen")
            got = energy(after, unary, nbrs, lam).first()["energy"]
            if got < reached:
                now, reached = after, got
                continue
            at_once = False
        movers = wish.where("wish <> label").select("cell_id", "gain")
        rivals = nbrs.where("w <> 0").select("i", "j").join(shuffled(movers).select(F.col("cell_id").alias("j"), F.col("gain").alias("theirs")), "j").join(shuffled(movers).select(F.col("cell_id").alias("i"), F.col("gain").alias("mine")), "i")
        held = rivals.where("theirs > mine or (theirs = mine and j < i)").select(F.col("i").alias("cell_id")).distinct().withColumn("_held", F.lit(True))
        now = written(wish.join(shuffled(held), "cell_id", "left").select("cell_id", F.when(F.col("_held"), F.col("label")).otherwise(F.col("wish")).alias("label"), "frozen"), "labels")
    return now


def wishes(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float, digits: int = 9) -> DataFrame:
    """labels with each cell's label of least local energy (wish; the first on ties) and what taking it gains; without a gain the wish is the label."""
    l = labels.select(F.col("cell_id").alias("j"), F.col("label").alias("k")).where("k >= 0")
    push = nbrs.join(shuffled(l), "j").groupBy(F.col("i").alias("cell_id"), "k").agg(F.sum("w").alias("w")).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("push"))
    cost = F.transform("costs", lambda c, k: F.round(c + lam * F.coalesce(F.try_element_at("push", k), F.lit(0.0)), digits))
    rows = labels.join(shuffled(unary), "cell_id").join(shuffled(push), "cell_id", "left").select("cell_id", "label", "frozen", cost.alias("_cost"))
    own = F.when(F.col("label") >= 0, F.get("_cost", F.col("label"))).otherwise(F.lit(float("inf")))
    gain = F.when(F.col("frozen"), F.lit(0.0)).otherwise(own - F.array_min("_cost"))
    return rows.select("cell_id", "label", "frozen", gain.alias("gain"), F.when(gain > 0, argmin(F.col("_cost"))).otherwise(F.col("label")).cast("int").alias("wish"))


#: Cells of a connected group that one task sweeps; larger groups go by waves.
GROUP_CELLS = 50_000


def icm_sequential(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float, most: int = 50, group_cells: int = GROUP_CELLS) -> DataFrame:
    """Sweeps in cell order with labels changed in place, exact and in parallel.

    Frozen neighbours are constants, so their push is folded into the unary and
    only connected groups of cells that aren't frozen depend on each other.  A
    group of at most `group_cells` cells is swept by itself in a task; larger
    ones go by waves: a cell moves once all its neighbours of smaller id have.
    """
    free = labels.where("not frozen").select("cell_id")
    fixed = labels.where("frozen and label >= 0").select(F.col("cell_id").alias("j"), F.col("label").alias("k"))
    push = nbrs.join(shuffled(fixed), "j").groupBy(F.col("i").alias("cell_id"), "k").agg(F.sum("w").alias("w")).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("push"))
    base = free.join(shuffled(unary), "cell_id").join(shuffled(push), "cell_id", "left").join(shuffled(labels).select("cell_id", "label"), "cell_id").select("cell_id", "label", F.transform("costs", lambda c, k: c + lam * F.coalesce(F.try_element_at("push", k), F.lit(0.0))).alias("costs"))
    inner = written(nbrs.join(shuffled(free).select(F.col("cell_id").alias("i")), "i", "left_semi").join(shuffled(free).select(F.col("cell_id").alias("j")), "j", "left_semi").select("i", "j", "w"), "inner")
    group = components(free, inner)
    sizes = group.groupBy("component").agg(F.count("*").alias("n"))
    rows = written(base.join(shuffled(group.join(shuffled(sizes), "component")), "cell_id"), "free")
    edges = inner.groupBy(F.col("i").alias("cell_id")).agg(F.collect_list(F.struct("j", "w")).alias("near"))

    def sweep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cell_id").reset_index(drop=True)
        at = {c: k for k, c in enumerate(g["cell_id"])}
        near = [[(at[e["j"]], e["w"]) for e in (x if x is not None else ())] for x in g["near"]]
        costs, label = np.stack(g["costs"].to_numpy()), g["label"].to_numpy().copy()
        for _ in range(most):
            changed = 0
            for k in range(len(g)):
                e = costs[k].copy()
                for n, w in near[k]:
                    if label[n] >= 0:
                        e[label[n]] += lam * w
                best = int(np.argmin(e))
                changed += best != label[k]
                label[k] = best
            if not changed:
                break
        return pd.DataFrame({"cell_id": g["cell_id"], "label": label.astype("int32"), "frozen": False})

    small = rows.where(F.col("n") <= group_cells).join(shuffled(edges), "cell_id", "left")
    done = small.groupBy("component").applyInPandas(sweep, "cell_id long, label int, frozen boolean")
    large = rows.where(F.col("n") > group_cells)
    if not large.isEmpty():
        swept = _waves(large.select("cell_id", F.col("label").cast("int").alias("label"), "costs"), inner, lam, most)
        done = done.unionByName(swept.select("cell_id", "label", F.lit(False).alias("frozen")))
    return done.unionByName(labels.where("frozen").select("cell_id", "label", "frozen"))


def _waves(cells: DataFrame, inner: DataFrame, lam: float, most: int) -> DataFrame:
    """The same sweeps of cells (cell_id, label, costs) as rounds of joins: a wave has the cells whose smaller neighbours are all in waves before."""
    inner = written(inner.join(shuffled(cells).select(F.col("cell_id").alias("i")), "i", "left_semi"), "edges")
    left, waves = cells.select("cell_id"), []
    while not left.isEmpty():
        held = inner.where("j < i").join(shuffled(left).select(F.col("cell_id").alias("j")), "j", "left_semi").select(F.col("i").alias("cell_id")).distinct()
        waves.append(written(left.join(shuffled(held), "cell_id", "left_anti"), "wave"))
        left = written(left.join(shuffled(waves[-1]), "cell_id", "left_anti"), "left")
    now = [written(cells.join(shuffled(w), "cell_id", "left_semi"), "labels") for w in waves]
    for _ in range(most):
        changed = 0
        for k, w in enumerate(waves):
            near = inner.join(shuffled(w).select(F.col("cell_id").alias("i")), "i", "left_semi")
            known = reduce(DataFrame.unionByName, [x.select(F.col("cell_id").alias("j"), F.col("label").alias("k")) for x in now]).where("k >= 0")
            push = near.join(shuffled(known), "j").groupBy(F.col("i").alias("cell_id"), "k").agg(F.sum("w").alias("w")).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("push"))
            cost = F.transform("costs", lambda c, k: c + lam * F.coalesce(F.try_element_at("push", k), F.lit(0.0)))
            moved = written(now[k].join(shuffled(push), "cell_id", "left").select("cell_id", argmin(cost).alias("label"), "costs", F.col("label").alias("old")), "labels")
            changed += moved.where("label <> old").limit(1).count()
            now[k] = moved.select("cell_id", "label", "costs")
        if not changed:
            break
    return reduce(DataFrame.unionByName, now)
