"""Tables that compare labelings with the truth: stages of one fit, several strategies, variants of one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.operators import estimators, metrics
from planarium.operators import diagnostics as diag
from planarium.operators.communities import CommunityStrategy
from planarium.operators.mosaic import MosaicStrategy, Result
from planarium.operators.pairs import nearest_distance
from planarium.operators.quantiles import exact_quantiles
from planarium.operators.ward import WardStrategy
from planarium.sources.store import written


def stage_trace(stages: list[tuple[str, DataFrame]], truth: DataFrame) -> DataFrame:
    """Rows (step, stage, cells, clusters, unlabelled, errors, ari), one for each stage.

    stages are (name, labels(cell_id, label)) in order, as a fit's
    model["stages"]; truth is (cell_id, y).  Clusters are named for the best
    agreement before errors are counted.  Cells of label -1 or null are
    unlabelled and count for neither errors nor ari; cells without a y are left
    out.  No stages are an error.  Only contingency tables reach the driver.
    """
    if not stages:
        raise ValueError("no stages")
    known = written(truth.where("y is not null").select("cell_id", "y"), "truth")
    rows = []
    for step, (name, labels) in enumerate(stages):
        named = metrics.relabelled(labels.select("cell_id", F.coalesce("label", F.lit(-1)).cast("int").alias("label")).join(known, "cell_id").withColumn("named", F.col("label")), label="named")
        rows.append(named.select(F.lit(step).alias("step"), F.lit(name).alias("stage"), "cell_id", "y", "label", "named"))
    rows = written(reduce(DataFrame.unionByName, rows), "stages")
    has = F.col("label") >= 0
    counts = rows.groupBy("step", "stage").agg(
        F.count("*").alias("cells"), F.count_distinct(F.when(has, F.col("label"))).alias("clusters"), F.count_if(~has).alias("unlabelled"), F.count_if(has & (F.col("named") != F.col("y"))).alias("errors")
    )
    return counts.join(metrics.adjusted_rand(rows.where(has), by=("step",)), "step", "left")


class MixtureStrategy:
    """Likeliest components of a Gaussian mixture, without any spatial term."""

    def __init__(self, n_clusters: int, covariance: str = "full", start: object = "kmeans", seed: int = 0):
        self.n_clusters, self.covariance, self.start, self.seed = n_clusters, covariance, start, seed

    def fit(self, cells: DataFrame) -> Result:
        points = written(cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("features").cast("array<double>").alias("features")), "points")
        m = estimators.fit_mixture(points, estimators.initial_means(points, self.n_clusters, self.start, self.seed), self.covariance)
        labels = diag.frozen_by_posterior(estimators.mixture_unary(points, m), 2.0).select("cell_id", "label")
        return Result(written(labels, "labels"), {"mixture": m})


def spacing(cells: DataFrame, factor: float = 3.0) -> float:
    """`factor` times the median distance of cells to their nearest neighbour; 0 for fewer than two cells."""
    q = exact_quantiles(nearest_distance(cells), "nn_d", [0.5]).first()
    return factor * q["q_0"] if q and q["q_0"] is not None else 0.0


def strategies(n_clusters: int, radius: float, mosaic: MosaicStrategy | None = None) -> dict[str, object]:
    """The six strategies by name: mixture, communities by coverage and by distance, Ward without and with penalty, mosaic."""
    return {
        "mixture": MixtureStrategy(n_clusters), "communities": CommunityStrategy(n_clusters, radius=radius), "communities_by_distance": CommunityStrategy.by_proximity(n_clusters, radius=radius),
        "ward": WardStrategy(n_clusters, radius=radius, lam=0.0), "ward_penalty": WardStrategy(n_clusters, radius=radius, lam=1.0), "mosaic": mosaic or MosaicStrategy(n_clusters, radius=radius),
    }


def ramp_variants(n_clusters: int, radius: float, low: float = 0.30, hard: float = 0.75, **given) -> dict[str, MosaicStrategy]:
    """One strategy with four ramps: plain, signed, signed logarithmic, and that with near-certain errors set free."""
    signed = {"signed": True, "low": low}
    variants = {"plain": {"signed": False}, "signed": signed, "signed_log": signed | {"log": True}, "signed_log_hard": signed | {"log": True, "hard": hard}}
    return {name: MosaicStrategy(n_clusters, radius=radius, **(given | v)) for name, v in variants.items()}


def compared(cells: DataFrame, truth: DataFrame, by_name: dict[str, object]) -> DataFrame:
    """stage_trace of the labels that each strategy gives, with the violations it found before and after its sweeps (null where it has none)."""
    fits = {name: s.fit(cells) for name, s in by_name.items()}
    found = [(name, r.model.get("violations_before"), r.model.get("violations_after")) for name, r in fits.items()]
    table = stage_trace([(name, r.labels) for name, r in fits.items()], truth).withColumnRenamed("stage", "strategy")
    return table.join(F.broadcast(cells.sparkSession.createDataFrame(found, "strategy string, violations_before long, violations_after long")), "strategy")  # a row for each strategy
