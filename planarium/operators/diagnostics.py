"""Tables that describe a labeling: posteriors, gaps, conflicts, errors, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planarium.functions.ramps import posterior
from planarium.operators.calibrate import labelled
from planarium.operators.graph import both_ways
from planarium.operators.quantiles import exact_quantiles
from planarium.sources.store import shuffled


def compact(labels: DataFrame, column: str = "label") -> DataFrame:
    """labels with the distinct values of 0 and more renamed to 0, 1, ... in order; -1 stays."""
    names = labels.where(F.col(column) >= 0).select(F.col(column).alias("_old")).distinct()
    names = names.select("_old", (F.dense_rank().over(Window.orderBy("_old")) - 1).cast("int").alias("_new"))  # of the distinct values
    return labels.join(names, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", F.lit(-1))).drop("_old", "_new")


def frozen_by_posterior(unary: DataFrame, least: float) -> DataFrame:
    """Rows (cell_id, label, posterior, frozen): the likeliest label, and whether its posterior reaches `least`."""
    p = unary.select("cell_id", F.explode(F.array(posterior(F.col("costs")))).alias("p"))
    return p.select("cell_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label"), F.array_max("p").alias("posterior")).withColumn("frozen", F.col("posterior") >= least)


def top_neighbour(pairs: DataFrame) -> DataFrame:
    """Rows (cell_id, neighbour, cf): the neighbour of highest coverage, the smaller id on ties."""
    best = both_ways(pairs.select("i", "j", "cf")).groupBy(F.col("i").alias("cell_id")).agg(F.max(F.struct("cf", (-F.col("j")).alias("m"))).alias("b"))
    return best.select("cell_id", (-F.col("b.m")).alias("neighbour"), "b.cf")


def quality(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (n, consistency): share of frozen cells whose top neighbour has their label; 0 without any."""
    l = lambda c: labels.select(F.col("cell_id").alias(c), F.col("label").alias(f"l_{c}"), F.col("frozen").alias(f"f_{c}"))
    rows = top_neighbour(pairs).join(shuffled(l("cell_id")), "cell_id").where("f_cell_id").join(shuffled(l("neighbour")), "neighbour")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("l_cell_id") == F.col("l_neighbour")).cast("double")), F.lit(0.0)).alias("consistency"))


def local_costs(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float) -> DataFrame:
    """Rows (cell_id, label, energies): each label's unary plus what the neighbours put on it; all further columns of labels stay."""
    l = labels.select(F.col("cell_id").alias("j"), F.col("label").alias("k")).where("k >= 0")
    push = nbrs.join(shuffled(l), "j").groupBy(F.col("i").alias("cell_id"), "k").agg(F.sum("w").alias("w")).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("push"))
    e = F.transform("costs", lambda c, k: c + lam * F.coalesce(F.try_element_at("push", k), F.lit(0.0)))
    return labels.join(shuffled(unary), "cell_id").join(shuffled(push), "cell_id", "left").withColumn("energies", e).drop("push")


def energy_gaps(labels: DataFrame, unary: DataFrame, nbrs: DataFrame, lam: float) -> DataFrame:
    """Rows (cell_id, gap): how much the second best label costs more than the best; 0 with one label."""
    s = F.array_sort("energies")
    return local_costs(labels, unary, nbrs, lam).select("cell_id", F.when(F.size("energies") >= 2, F.get(s, F.lit(1)) - F.get(s, F.lit(0))).otherwise(0.0).alias("gap"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (cell_id, old, new) of cells whose label changed."""
    return before.select("cell_id", F.col("label").alias("old")).join(shuffled(after).select("cell_id", F.col("label").alias("new")), "cell_id").where("old <> new")


def neighbour_shares(nbrs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (cell_id, label, n, share): how a cell's labelled neighbours divide among labels."""
    l = labels.select(F.col("cell_id").alias("j"), "label").where("label >= 0")
    counts = nbrs.join(shuffled(l), "j").groupBy(F.col("i").alias("cell_id"), "label").agg(F.count("*").alias("n"))
    return counts.join(shuffled(counts).groupBy("cell_id").agg(F.sum("n").alias("all")), "cell_id").select("cell_id", "label", "n", (F.col("n") / F.col("all")).alias("share"))


def errors(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows (cell_id, label, y) where they differ."""
    return labels.select("cell_id", "label").join(shuffled(truth).select("cell_id", "y"), "cell_id").where("label <> y")


def error_counts(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows (y, n, n_errors, share) for each true class."""
    rows = labels.select("cell_id", "label").join(shuffled(truth).select("cell_id", "y"), "cell_id")
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("y")).alias("n_errors")).withColumn("share", F.col("n_errors") / F.col("n"))


def error_summary(labels: DataFrame, truth: DataFrame, nbrs: DataFrame, posteriors: DataFrame) -> DataFrame:
    """Rows (cell_id, y, label, posterior, conflict, n_same, n_true, frozen, diagnosis), one for each wrong label.

    conflict sums the positive weights of neighbours with the cell's label; a
    wrong cell without conflict has no spatial signal (B), one with conflict
    was frozen (A frozen) or not moved (A unfixed).
    """
    near = nbrs.where("w > 0").join(shuffled(labels).select(F.col("cell_id").alias("j"), F.col("label").alias("k")), "j").select(F.col("i").alias("cell_id"), "k", "w")
    wrong = errors(labels, truth)
    sums = wrong.join(shuffled(near), "cell_id").groupBy("cell_id").agg(F.sum(F.when(F.col("k") == F.col("label"), F.col("w")).otherwise(0.0)).alias("conflict"), F.count_if(F.col("k") == F.col("label")).alias("n_same"), F.count_if(F.col("k") == F.col("y")).alias("n_true"))
    rows = wrong.join(shuffled(sums), "cell_id", "left").join(shuffled(posteriors).select("cell_id", "posterior", "frozen"), "cell_id").fillna({"conflict": 0.0, "n_same": 0, "n_true": 0})
    kind = F.when(F.col("conflict") == 0, "B").when(F.col("frozen"), "A frozen").otherwise("A unfixed")
    return rows.select("cell_id", "y", "label", "posterior", "conflict", "n_same", "n_true", "frozen", kind.alias("diagnosis"))


def worst(rows: DataFrame, by: Column, n: int = 8) -> DataFrame:
    """The n rows of largest `by`, the larger cell_id first on ties."""
    return rows.orderBy(by.desc(), F.desc("cell_id")).limit(n)


def empirical_thresholds(pairs: DataFrame, truth: DataFrame, same_q: float = 0.99, other_q: float = 0.25, least: int = 10) -> DataFrame:
    """Rows (same, n, tau): a high quantile of coverage among cells of one true class, a low one among others; null below `least` pairs."""
    y = lambda c: truth.select(F.col("cell_id").alias(c), F.col("y").alias(f"y_{c}"))
    rows = pairs.join(shuffled(y("i")), "i").join(shuffled(y("j")), "j").select((F.col("y_i") == F.col("y_j")).alias("same"), "cf")
    q = exact_quantiles(rows, "cf", [same_q, other_q], ["same"])
    return q.select("same", "n", F.when(F.col("n") >= least, F.when(F.col("same"), F.col("q_0")).otherwise(F.col("q_1"))).alias("tau"))


def gallery(pairs: DataFrame, labels: DataFrame, same: tuple[float, ...] = (5, 35, 70, 100), other: tuple[float, ...] = (5, 95)) -> DataFrame:
    """Rows (same, pct, i, j, cf): the pairs at nearest ranks of coverage; of equal coverage, the first by ids."""
    rows = labelled(pairs, labels).select("i", "j", "cf", (F.col("label_i") == F.col("label_j")).alias("same"))
    sizes = {r["same"]: r["n"] for r in rows.groupBy("same").agg(F.count("*").alias("n")).collect()}
    out = None
    for kind, percents in ((True, same), (False, other)):
        n = sizes.get(kind, 0)
        ranks = [round(p / 100 * (n - 1)) for p in percents] if n else []
        if not ranks:
            continue
        own = rows.where(F.col("same") == kind)
        q = exact_quantiles(own, "cf", [r / max(n - 1, 1) for r in ranks])
        at = q.select(F.explode(F.array(*(F.struct(F.lit(float(p)).alias("pct"), F.col(f"q_{i}").alias("cf")) for i, p in enumerate(percents)))).alias("x")).select("x.pct", "x.cf")
        got = F.broadcast(at).join(own, "cf").groupBy("same", "pct").agg(F.min(F.struct("i", "j", "cf")).alias("x")).select("same", "pct", "x.i", "x.j", "x.cf")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.limit(0).select("same", F.lit(0.0).alias("pct"), "i", "j", "cf")


def unfrozen_hard_pairs(labels: DataFrame, pairs: DataFrame, theta: float) -> DataFrame:
    """labels with the cells of almost certain mistakes no longer frozen: pairs of one label with coverage above theta."""
    hard = labelled(pairs, labels).where((F.col("label_i") == F.col("label_j")) & (F.col("cf") > theta))
    ends = hard.select(F.explode(F.array("i", "j")).alias("cell_id")).distinct().withColumn("_hard", F.lit(True))
    return labels.join(shuffled(ends), "cell_id", "left").withColumn("frozen", F.col("frozen") & F.col("_hard").isNull()).drop("_hard")


def boundary_pairs(pairs: DataFrame, before: DataFrame, after: DataFrame, tau: float) -> DataFrame:
    """Pairs (i, j, cf) that a merge made equal in label: different before, coverage of tau or more."""
    old = labelled(pairs.where(F.col("cf") >= tau), before).where("label_i <> label_j").select("i", "j", "cf")
    return labelled(old, after).where("label_i = label_j").select("i", "j", "cf")


def extents(cells: DataFrame, by: str | None = None) -> DataFrame:
    """Rows (x0, x1, y0, y1): bounds of all vertices, with `by` for each of its values."""
    keys = [by] if by else []
    return cells.select(*keys, F.explode("poly").alias("p")).groupBy(*keys).agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1"))
