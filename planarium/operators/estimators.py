"""Feature clustering: k-means, Gaussian mixtures with given means, densities as unary costs.

points are rows (cell_id, features).  Parameters are as large as the number of
clusters and stay on the driver; sums over the points are Spark aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.sources.store import shuffled

COVARIANCES = ("full", "tied", "diag", "spherical")


def _vectors(points: DataFrame) -> DataFrame:
    return points.select("cell_id", array_to_vector(F.col("features").cast("array<double>")).alias("features"))


def kmeans(points: DataFrame, k: int, seed: int = 0, **options) -> DataFrame:
    """Rows (cell_id, label) of Spark's k-means."""
    v = _vectors(points)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label", **options).fit(v).transform(v).select("cell_id", F.col("label").cast("int").alias("label"))


def gaussian_mixture(points: DataFrame, k: int, seed: int = 0, **options) -> DataFrame:
    """Rows (cell_id, label) of Spark's Gaussian mixture (full covariances)."""
    v = _vectors(points)
    return GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="label", **options).fit(v).transform(v).select("cell_id", F.col("label").cast("int").alias("label"))


def cluster_means(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (label, n, mean): mean vector of each cluster; -1 has none."""
    rows = points.join(shuffled(labels).select("cell_id", "label").where("label >= 0"), "cell_id").select("label", F.posexplode("features").alias("d", "x"))
    means = rows.groupBy("label", "d").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))


def ward_deltas(means: DataFrame) -> DataFrame:
    """Rows (a, b, delta), a < b: growth of the sum of squares if two clusters of cluster_means were one."""
    b = means.select(F.col("label").alias("b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    d2 = F.aggregate(F.zip_with("mean", "mean_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    rows = means.withColumnRenamed("label", "a").join(b, F.col("a") < F.col("b"))  # as many rows as pairs of clusters
    return rows.select("a", "b", (F.col("n") * F.col("n_b") / (F.col("n") + F.col("n_b")) * d2).alias("delta"))


def principal_plane(points: DataFrame) -> DataFrame:
    """Rows (cell_id, u, v): centred features on their two main axes."""
    v = _vectors(points)
    c = StandardScaler(inputCol="features", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    p = PCA(k=2, inputCol="c", outputCol="p").fit(c).transform(c).select("cell_id", vector_to_array("p").alias("p"))
    return p.select("cell_id", F.get("p", F.lit(0)).alias("u"), F.get("p", F.lit(1)).alias("v"))


@dataclass
class Mixture:
    """Weights (K), means (K, d) and covariances (K, d, d) of a Gaussian mixture."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def costs(self, x: np.ndarray) -> np.ndarray:
        """-(log density + log weight) of each row for each component."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, k] = 0.5 * (z * z).sum(axis=0) + np.log(np.diag(low)).sum() + 0.5 * len(m) * np.log(2 * np.pi) - np.log(max(w, 1e-300))
        return out

    def ellipses(self, axes: np.ndarray | None = None) -> list[tuple[int, float, float, float, float, float]]:
        """(component, x, y, long axis, short axis, angle) of one standard deviation, in the first two dimensions or on given axes (2, d)."""
        out = []
        for k, (m, c) in enumerate(zip(self.means, self.covariances)):
            m, c = (m[:2], c[:2, :2]) if axes is None else (axes @ m, axes @ c @ axes.T)
            values, vectors = np.linalg.eigh(c)
            out.append((k, float(m[0]), float(m[1]), *(float(np.sqrt(max(v, 0.0))) for v in values[::-1]), float(np.arctan2(vectors[1, -1], vectors[0, -1]))))
        return out


def _moments(points: DataFrame, mixture: Mixture) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean log-likelihood, and the sums of shares, of shares times x, and of shares times x x' for each component."""
    shared = points.sparkSession.sparkContext.broadcast(mixture)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = s = q = like = rows = 0
        for b in batches:
            x = np.stack(b["features"].to_numpy()).astype(float)
            c = -shared.value.costs(x)
            top = c.max(axis=1, keepdims=True)
            e = np.exp(c - top)
            r = e / e.sum(axis=1, keepdims=True)
            like, rows = like + float((top[:, 0] + np.log(e.sum(axis=1))).sum()), rows + len(x)
            n, s, q = n + r.sum(axis=0), s + r.T @ x, q + np.einsum("nk,ni,nj->kij", r, x, x)
        if rows:
            yield pd.DataFrame({"part": [0], "rows": [rows], "like": [like], "n": [n], "s": [s.ravel()], "q": [q.ravel()]})

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "rows": [parts["rows"].sum()], "like": [parts["like"].sum()], **{c: [np.stack(parts[c].to_numpy()).sum(axis=0)] for c in "nsq"}})

    schema = "part int, rows long, like double, n array<double>, s array<double>, q array<double>"
    partial = points.select("features").mapInPandas(sums, schema).withColumn("part", (F.spark_partition_id() % 64).cast("int"))
    # Sums of sums: a row for each task, then for each of 64 groups of tasks.
    got = partial.groupBy("part").applyInPandas(add, schema).collect()
    k, d = mixture.means.shape
    n, s, q = (np.sum([r[c] for r in got], axis=0) for c in "nsq")
    return sum(r["like"] for r in got) / max(1, sum(r["rows"] for r in got)), n, s.reshape(k, d), q.reshape(k, d, d)


def fit_mixture(points: DataFrame, means: np.ndarray, covariance: str = "full", rounds: int = 100, tolerance: float = 1e-3, floor: float = 1e-6) -> Mixture:
    """Expectation maximisation from given means; each round is one pass over the points."""
    if covariance not in COVARIANCES:
        raise ValueError(f"covariance must be one of {COVARIANCES}")
    k, d = means.shape
    start = points.select(F.posexplode("features").alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("v")).orderBy("d").collect()
    spread = np.diag([(r["v"] or 0.0) + floor for r in start])
    mixture, last = Mixture(np.full(k, 1 / k), means.astype(float), np.stack([spread] * k)), None
    for _ in range(rounds):
        like, n, s, q = _moments(points, mixture)
        n = np.maximum(n, 10 * np.finfo(float).eps)
        m = s / n[:, None]
        c = q / n[:, None, None] - np.einsum("ki,kj->kij", m, m)
        if covariance == "tied":
            c = np.stack([np.einsum("k,kij->ij", n, c) / n.sum()] * k)
        elif covariance != "full":
            v = np.maximum(np.einsum("kii->ki", c), 0.0)
            v = np.repeat(v.mean(axis=1, keepdims=True), d, axis=1) if covariance == "spherical" else v
            c = np.stack([np.diag(x) for x in v])
        mixture = Mixture(n / n.sum(), m, c + floor * np.eye(d))
        if last is not None and abs(like - last) < tolerance:
            break
        last = like
    return mixture


def mixture_unary(points: DataFrame, mixture: Mixture) -> DataFrame:
    """Rows (cell_id, costs)."""
    shared = points.sparkSession.sparkContext.broadcast(mixture)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cell_id": b["cell_id"], "costs": list(shared.value.costs(np.stack(b["features"].to_numpy()).astype(float)))})

    return points.select(F.col("cell_id").cast("long").alias("cell_id"), "features").mapInPandas(run, "cell_id long, costs array<double>")


def initial_means(points: DataFrame, k: int, how: str | Callable[[DataFrame, int, int], DataFrame] = "kmeans", seed: int = 0) -> np.ndarray:
    """K starting means: of k-means clusters, of random rows, or of the labels that a function (points, k, seed) gives.

    Means that labels give must be k, else those of k-means are taken.
    """
    if how == "random":
        rows = points.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(k).select("features").collect()
        return np.array([r["features"] for r in rows], dtype=float)
    if how != "kmeans" and not callable(how):
        raise ValueError(f"unknown way to start: {how}")
    labels = how(points, k, seed) if callable(how) else kmeans(points, k, seed)
    rows = cluster_means(points, labels).orderBy("label").collect()
    if len(rows) != k and callable(how):
        return initial_means(points, k, "kmeans", seed)
    return np.array([r["mean"] for r in rows], dtype=float)


def density_unary(points: DataFrame, labels: DataFrame, mixture: Mixture) -> DataFrame:
    """Rows (cell_id, costs): as mixture_unary, with kernel densities of the clusters' members in place of the Gaussians.

    The bandwidth is Scott's rule on the cluster's covariance; clusters with
    fewer than two members or a singular covariance keep their Gaussian.  The
    members of a cluster meet the points in salted blocks.
    """
    block = 2_000
    own = points.join(shuffled(labels).select("cell_id", "label").where("label >= 0"), "cell_id")
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    d = mixture.means.shape[1]
    usable = {k: np.linalg.cholesky(np.linalg.inv(mixture.covariances[k] * n ** (-2 / (d + 4)))) for k, n in sizes.items() if n >= 2 and k < len(mixture.weights) and np.linalg.cond(mixture.covariances[k]) < 1e12}
    shared = points.sparkSession.sparkContext.broadcast((mixture, usable, sizes))
    queries = max(1, -(-points.count() // block))
    members = own.where(F.col("label").isin([int(k) for k in usable])).select("label", "features", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))).alias("q"), F.pmod(F.xxhash64("cell_id"), F.lit(max(1, -(-max(sizes.values(), default=1) // block)))).alias("m"))
    cells = points.select("cell_id", "features", F.pmod(F.xxhash64("cell_id"), F.lit(queries)).alias("q"))
    parts = members.select("label", "q", "m").distinct()
    members = members.select(*(F.col(c).alias(c) for c in members.columns))  # columns of their own: both sides come from the points

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"cell_id": [], "label": [], "s": []}).astype({"cell_id": "int64", "label": "int32", "s": "float64"})
        k = int(y["label"].iloc[0])
        low = shared.value[1][k]
        a, b = np.stack(x["features"].to_numpy()) @ low, np.stack(y["features"].to_numpy()) @ low
        d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
        e = -0.5 * np.maximum(d2, 0.0)
        top = e.max(axis=1)
        return pd.DataFrame({"cell_id": x["cell_id"], "label": np.int32(k), "s": top + np.log(np.exp(e - top[:, None]).sum(axis=1))})

    met = cells.join(parts, "q").groupBy("label", "q", "m").cogroup(members.groupBy("label", "q", "m")).applyInPandas(run, "cell_id long, label int, s double")
    top = met.groupBy("cell_id", "label").agg(F.max("s").alias("top"))
    sums = met.join(top, ["cell_id", "label"]).groupBy("cell_id", "label").agg((F.first("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))))).alias("s"))
    shift = {k: float(np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi) - np.log(sizes[k]) + np.log(mixture.weights[k])) for k, low in usable.items()}
    if not shift:
        return mixture_unary(points, mixture)
    given = F.create_map(*(F.lit(x) for k, v in shift.items() for x in (int(k), v)))
    kernel = sums.select("cell_id", "label", (-(F.col("s") + given[F.col("label")])).alias("c")).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("kernel"))
    return mixture_unary(points, mixture).join(shuffled(kernel), "cell_id", "left").select("cell_id", F.transform("costs", lambda c, k: F.coalesce(F.try_element_at("kernel", k), c)).alias("costs"))
