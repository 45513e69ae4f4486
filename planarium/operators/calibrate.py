"""Thresholds and weights estimated from labelled pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.operators.graph import both_ways
from planarium.operators.pairs import nearest_distance
from planarium.operators.quantiles import exact_quantiles
from planarium.sources.store import shuffled


def labelled(pairs: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """pairs with label_i and label_j (and further columns of both cells)."""
    side = lambda c: shuffled(labels).select(F.col("cell_id").alias(c), F.col("label").alias(f"label_{c}"), *(F.col(x).alias(f"{x}_{c}") for x in columns))
    return pairs.join(side("i"), "i").join(side("j"), "j")


def tau_low_per_cluster(pairs: DataFrame, labels: DataFrame, least_pairs: int = 5, default: float = 0.05, q: float = 0.75) -> DataFrame:
    """Rows (cell_id, tau): a quantile of the coverage inside each cell's cluster, the default below `least_pairs` pairs."""
    same = exact_quantiles(labelled(pairs, labels).where("label_i = label_j").select(F.col("label_i").alias("label"), "cf"), "cf", [q], ["label"]).withColumnRenamed("q_0", "t")
    return labels.join(same.where(F.col("n") >= least_pairs), "label", "left").select("cell_id", F.coalesce("t", F.lit(default)).alias("tau"))


@dataclass
class Thresholds:
    low: float
    high: float
    source: str


def calibrated(pairs: DataFrame, labels: DataFrame, low_q: float = 0.75, high_q: float = 0.5, signed: bool = False, least_pairs: int = 10) -> Thresholds:
    """Thresholds from pairs of equal and of different labels; frozen pairs come first, then all, then the priors.

    The four kinds of pairs are groups of one exact quantile job.
    """
    p = labelled(pairs, labels, "frozen")
    same, frozen = F.col("label_i") == F.col("label_j"), F.col("frozen_i") & F.col("frozen_j")
    kinds = F.array(F.when(same, "s").otherwise("d"), F.when(frozen, F.when(same, "sf").otherwise("df")))
    kinds = p.select("cf", F.explode(F.array_compact(kinds)).alias("kind"))
    r = {f"n_{k}": 0 for k in ("s", "sf", "d", "df")} | {f"q_{k}": None for k in ("s", "sf", "d", "df")}
    for x in exact_quantiles(kinds, "cf", [low_q, high_q], ["kind"]).collect():
        r |= {f"n_{x['kind']}": x["n"], f"q_{x['kind']}": x["q_0" if x["kind"][0] == "s" else "q_1"]}
    prior = (0.30 if signed else 0.10, 0.40)
    pick = lambda names, other: next(((r[f"q_{k}"], k) for k in names if r[f"n_{k}"] >= least_pairs), (other, "prior"))
    (low, a), (high, b) = pick(("sf", "s"), prior[0]), pick(("df", "d"), prior[1])
    if low >= high - 0.05:
        low, high, a, b = *prior, "prior", "prior"
    low = min(max(low, 0.01), 0.49)
    return Thresholds(low, min(max(high, low + 0.05), 0.99), f"{a}/{b}")


def label_push(pairs: DataFrame, labels: DataFrame, tau: float) -> DataFrame:
    """Rows (cell_id, push): what frozen cells of the same label put on a cell that isn't frozen."""
    p = labelled(both_ways(pairs.select("i", "j", "cf")), labels, "frozen").where((F.col("label_i") == F.col("label_j")) & ~F.col("frozen_i") & F.col("frozen_j") & (F.col("cf") > tau))
    return p.groupBy(F.col("i").alias("cell_id")).agg(F.sum(F.least(F.lit(1.0), (F.col("cf") - tau) / max(1 - tau, 1e-6))).alias("push"))


def nnd_cv(cells: DataFrame, by: str = "label") -> DataFrame:
    """Rows (label, n, cv): spread of the nearest-neighbour distances within each cluster; infinite below two cells."""
    near = nearest_distance(cells, by)
    stats = cells.join(shuffled(near), "cell_id", "left").groupBy(by).agg(F.count("*").alias("n"), F.stddev_pop("nn_d").alias("s"), F.avg("nn_d").alias("m"))
    return stats.select(F.col(by).alias("label"), "n", F.when(F.col("n") < 2, F.lit(float("inf"))).when(F.col("m") == 0, 0.0).otherwise(F.col("s") / F.nullif(F.col("m"), F.lit(0.0))).alias("cv"))


def merge_gates(pairs: DataFrame, labels: DataFrame, tau: float) -> DataFrame:
    """Rows (a, b, n_pairs, n_high, frozen_pairs, frozen_high) for each pair of clusters that touch."""
    p = labelled(pairs, labels, "frozen").where("label_i <> label_j")
    frozen, high = F.col("frozen_i") & F.col("frozen_j"), F.col("cf") >= tau
    return p.groupBy(F.least("label_i", "label_j").alias("a"), F.greatest("label_i", "label_j").alias("b")).agg(F.count("*").alias("n_pairs"), F.count_if(high).alias("n_high"), F.count_if(frozen).alias("frozen_pairs"), F.count_if(frozen & high).alias("frozen_high"))


def tau_of_frozen(pairs: DataFrame, labels: DataFrame, q: float = 0.75, least_pairs: int = 10) -> DataFrame:
    """Rows (label, n, tau) of clusters with enough pairs of frozen cells: a quantile of their coverage, kept within 0.01 and 0.49."""
    p = labelled(pairs, labels, "frozen").where("label_i = label_j and frozen_i and frozen_j").select(F.col("label_i").alias("label"), "cf")
    return exact_quantiles(p, "cf", [q], ["label"]).where(F.col("n") >= least_pairs).select("label", "n", F.least(F.greatest("q_0", F.lit(0.01)), F.lit(0.49)).alias("tau"))


def penalty_weight(pairs: DataFrame, labels: DataFrame, unary: DataFrame, low: float, alpha: float = 1.0, least: int = 10, most_broken: float = 0.2) -> DataFrame:
    """One row (lam, gap, push, n_free, n_pushed, n_anchors, broken): how strong the pair penalty must be to outweigh the unary.

    lam is alpha times the median gap between the two cheapest labels of cells
    that aren't frozen, over the median push that frozen cells put on them.  It
    is null without `least` free cells, pushed cells or frozen anchors (pairs of
    frozen cells of one label, of which at most the share `most_broken` may lie
    above the threshold), or without a gap.
    """
    free = labels.where("not frozen").join(shuffled(unary), "cell_id").select("cell_id", F.array_sort("costs").alias("c")).where(F.size("c") >= 2)
    gap = exact_quantiles(free.select((F.get("c", F.lit(1)) - F.get("c", F.lit(0))).alias("g")), "g", [0.5]).select(F.col("n").alias("n_free"), F.col("q_0").alias("gap"))
    push = exact_quantiles(label_push(pairs, labels, low), "push", [0.5]).select(F.col("n").alias("n_pushed"), F.col("q_0").alias("push"))
    anchors = labelled(pairs, labels, "frozen").where("label_i = label_j and frozen_i and frozen_j").agg(F.count("*").alias("n_anchors"), F.coalesce(F.avg((F.col("cf") > low).cast("double")), F.lit(0.0)).alias("broken"))
    # One row with at most one row each.
    rows = anchors.join(gap, F.lit(True), "left").join(push, F.lit(True), "left")
    ok = (F.col("n_free") >= least) & (F.col("n_anchors") >= least) & (F.col("broken") <= most_broken) & (F.col("n_pushed") >= least) & (F.col("gap") > 0)
    return rows.select(F.when(ok, alpha * F.col("gap") / F.nullif(F.col("push"), F.lit(0.0))).alias("lam"), "gap", "push", F.coalesce("n_free", F.lit(0)).alias("n_free"), F.coalesce("n_pushed", F.lit(0)).alias("n_pushed"), "n_anchors", "broken")


def mixture_threshold(pairs: DataFrame, q: float = 0.75, least_pairs: int = 20, least_low: int = 10, rounds: int = 200) -> float | None:
    """A quantile of the lower of two Gaussian components of all coverage fractions; None with too few of either.

    The components are fitted by expectation maximisation, each round one
    aggregate of sums over the pairs.
    """
    s = pairs.agg(F.count("cf").alias("n"), F.min("cf").alias("a"), F.max("cf").alias("b"), F.var_pop("cf").alias("v")).first()
    if s["n"] < least_pairs or s["a"] == s["b"]:
        return None
    m, v, w, last = [s["a"] + 0.25 * (s["b"] - s["a"]), s["a"] + 0.75 * (s["b"] - s["a"])], [s["v"] / 4 + 1e-6] * 2, [0.5, 0.5], None
    x = F.col("cf")

    def share():
        d = [F.lit(w[k] / v[k] ** 0.5) * F.exp(-(x - m[k]) * (x - m[k]) / (2 * v[k])) for k in (0, 1)]
        return F.when(d[0] + d[1] > 0, d[0] / (d[0] + d[1])).otherwise((F.abs(x - m[0]) <= F.abs(x - m[1])).cast("double")), F.log(F.greatest(d[0] + d[1], F.lit(1e-300)))

    for _ in range(rounds):
        r, like = share()
        t = pairs.agg(F.sum(r).alias("n"), F.sum(r * x).alias("s"), F.sum(r * x * x).alias("q"), F.sum((1 - r) * x).alias("s2"), F.sum((1 - r) * x * x).alias("q2"), F.avg(like).alias("l")).first()
        n = [max(t["n"], 1e-9), max(s["n"] - t["n"], 1e-9)]
        m = [t["s"] / n[0], t["s2"] / n[1]]
        v = [max(t["q"] / n[0] - m[0] ** 2, 0.0) + 1e-6, max(t["q2"] / n[1] - m[1] ** 2, 0.0) + 1e-6]
        w = [n[0] / s["n"], n[1] / s["n"]]
        if last is not None and abs(t["l"] - last) < 1e-3:
            break
        last = t["l"]
    low = 0 if m[0] <= m[1] else 1
    r, _ = share()
    own = pairs.where((r >= 0.5) if low == 0 else (r < 0.5))
    got = exact_quantiles(own, "cf", [q]).first()
    return got["q_0"] if got and got["n"] >= least_low else None
