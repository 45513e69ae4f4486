"""Estimators, merging, cleanup and the whole strategy on small fields of cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarium.operators import cleanup, estimators, graph, merging, metrics, mosaic, quantiles, refine
from planarium.operators import diagnostics as diag
from planarium.operators.calibrate import mixture_threshold, penalty_weight, tau_of_frozen


@pytest.fixture(scope="module")
def field(spark):
    """Three interleaved grids of hexagons whose features overlap a little."""
    rng = np.random.default_rng(5)
    rows = []
    for k, (dx, dy) in enumerate(((0, 0), (3.1, 2.2), (6.3, 4.9))):
        for a in range(6):
            for b in range(6):
                x, y = a * 10 + dx + rng.normal(0, 0.3), b * 10 + dy + rng.normal(0, 0.3)
                poly = [(x + 5.3 * math.cos(t * math.pi / 3), y + 5.3 * math.sin(t * math.pi / 3)) for t in range(6)]
                rows.append((len(rows), float(x), float(y), False, [(float(p), float(q)) for p, q in poly], (rng.normal(0, 0.45, 2) + [(0, 0), (1.4, 0), (0.7, 1.3)][k]).tolist(), k))
    return spark.createDataFrame(rows, "cell_id long, cx double, cy double, clipped boolean, poly array<struct<x:double,y:double>>, features array<double>, y int").cache()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g in ("a", None, "c") for v in np.round(rng.normal(size=500 if g else 7), 1)] + [("a", None), ("d", 4.0)] + [("hot", 1.0)] * 2000 + [("hot", 2.0)] * 5
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: [r[f"q_{i}"] for i in range(5)] for r in quantiles.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", qs, ["g"], parts=8).collect()}
    assert set(got) == {"a", None, "c", "d", "hot"}
    for g, v in got.items():
        assert v == pytest.approx(np.quantile([x for k, x in rows if k == g and x is not None], qs).tolist())
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).count() == 0


def test_mixture_against_numpy(spark, field):
    points = field.select("cell_id", "features")
    start = np.array([[0.0, 0.0], [1.4, 0.0], [0.7, 1.3]])
    x = np.array([r["features"] for r in points.orderBy("cell_id").collect()])
    for covariance in estimators.COVARIANCES:
        got = estimators.fit_mixture(points, start, covariance, rounds=4, tolerance=0)
        w, m, c = np.full(3, 1 / 3), start, np.stack([np.diag(x.var(axis=0) + 1e-6)] * 3)
        for _ in range(4):
            like = np.stack([w[k] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m[k], np.linalg.inv(c[k]), x - m[k])) / np.sqrt(np.linalg.det(c[k])) for k in range(3)], axis=1)
            r = like / like.sum(axis=1, keepdims=True)
            n, m = r.sum(axis=0), r.T @ x / r.sum(axis=0)[:, None]
            c = np.stack([(r[:, k, None] * (x - m[k])).T @ (x - m[k]) / n[k] for k in range(3)])
            if covariance == "tied":
                c = np.stack([np.einsum("k,kij->ij", n, c) / n.sum()] * 3)
            elif covariance == "diag":
                c = np.stack([np.diag(np.diag(a)) for a in c])
            elif covariance == "spherical":
                c = np.stack([np.eye(2) * np.diag(a).mean() for a in c])
            w, c = n / n.sum(), c + 1e-6 * np.eye(2)
        assert np.allclose(got.weights, w) and np.allclose(got.means, m) and np.allclose(got.covariances, c)
    costs = np.array([r["costs"] for r in estimators.mixture_unary(points, got).orderBy("cell_id").collect()])
    assert np.allclose(costs, got.costs(x))
    with pytest.raises(ValueError):
        estimators.fit_mixture(points, start, "other")
    with pytest.raises(ValueError):
        estimators.initial_means(points, 3, "other")
    assert estimators.initial_means(points, 3, "random", 1).shape == (3, 2) and len(got.ellipses()) == 3


def test_kernel_density(spark, field):
    points, labels = field.select("cell_id", "features"), field.select("cell_id", F.col("y").alias("label"))
    m = estimators.fit_mixture(points, np.array([[0.0, 0.0], [1.4, 0.0], [0.7, 1.3]]), rounds=2)
    got = {r["cell_id"]: r["costs"] for r in estimators.density_unary(points, labels, m).collect()}
    rows = field.orderBy("cell_id").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows])
    for k in range(3):
        own = x[y == k]
        c = m.covariances[k] * len(own) ** (-2 / 6)
        d = x[:, None] - own[None]
        p = np.exp(-0.5 * np.einsum("nmi,ij,nmj->nm", d, np.linalg.inv(c), d)).mean(axis=1) / (2 * np.pi * np.sqrt(np.linalg.det(c)))
        assert np.allclose([got[i][k] for i in range(len(x))], -(np.log(p) + np.log(m.weights[k])))


def test_kmeans_and_gaussian_mixture(spark, field):
    truth = field.select("cell_id", "y")
    for f in (estimators.kmeans, estimators.gaussian_mixture):
        got = f(field, 3)
        assert got.count() == field.count() and metrics.adjusted_rand(got.join(truth, "cell_id")).first()["ari"] > 0.4
    plane = estimators.principal_plane(field).agg(F.avg("u").alias("u"), F.avg("v").alias("v")).first()
    assert abs(plane["u"]) < 1e-9 and abs(plane["v"]) < 1e-9


def test_split_and_merge(spark, field):
    labels = field.select("cell_id", F.lit(0).alias("label"))
    far = field.withColumn("cx", F.when(F.col("cell_id") % 2 == 0, F.col("cx")).otherwise(F.col("cx") + 900))
    parts, parents = merging.split_fragmented(far, labels)
    rows = far.orderBy("cell_id").collect()
    xy = np.array([(r["cx"], r["cy"]) for r in rows])
    apart = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    near = apart <= 2.5 * np.median(np.sort(apart, axis=1)[:, 2])
    for _ in range(8):
        near = near.astype(int) @ near.astype(int) > 0
    first = near.argmax(axis=1)
    got = {r["cell_id"]: r["label"] for r in parts.collect()}
    assert len(parents) == len(set(first)) - 1 > 0 and set(parents.values()) == {0}
    assert all((got[i] == got[j]) == (first[i] == first[j]) for i in range(len(rows)) for j in range(len(rows))) and got[0] == 0
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0.0]])
    assert merging.linkage(d, 2) == [[0, 1], [2, 3]] == merging.linkage(d, 2, "single") == merging.linkage(d, 2, "average")
    four = field.select("cell_id", (F.col("y") + F.when((F.col("y") == 0) & (F.col("cx") > 28), 3).otherwise(0)).alias("label"), F.lit(True).alias("frozen"))
    pairs = mosaic.coverage_map(field, 20.0)
    for greedy in (False, True):
        got, history, groups = merging.merge_to_k(four, field, pairs, 0.1, 3, greedy=greedy)
        assert groups == [[0, 3], [1], [2]] and [(a, b) for a, b, _ in history] == [(0, 3)]
        assert got.join(field.select("cell_id", "y"), "cell_id").where("label <> y").count() == 0
    g = graph.feature_graph(field.select("cell_id", "features"), 8)
    got, merges = merging.iterative_merge(field, field.select("cell_id", F.col("y").alias("label")), g, theta=0.0, delta=9.0)
    assert merges == 0 and got.join(field.select("cell_id", "y"), "cell_id").where("label <> y").count() == 0


def test_regularity_gain_against_numpy(spark, field):
    rows = field.orderBy("cell_id").collect()
    xy, y = np.array([(r["cx"], r["cy"]) for r in rows]), np.array([r["y"] for r in rows])

    def cv(p):
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        return d.min(axis=1).std() / d.min(axis=1).mean()

    got = merging.regularity_gains(field, field.select("cell_id", F.col("y").alias("label")), [(0, 1), (1, 2)])
    for (a, b), v in got.items():
        assert v == pytest.approx(cv(xy[y == a]) + cv(xy[y == b]) - 2 * cv(xy[(y == a) | (y == b)]))


def test_cleanup_lowers_energy(spark, field):
    pairs = mosaic.coverage_map(field, 20.0)
    nbrs = refine.neighbours(pairs, 0.1, 0.4)
    rng = np.random.default_rng(3)
    n = field.count()
    unary = spark.createDataFrame([(i, rng.random(3).round(3).tolist()) for i in range(n)], "cell_id long, costs array<double>").cache()
    labels = spark.createDataFrame([(i, int(rng.integers(0, 3)), bool(i % 5 == 0)) for i in range(n)], "cell_id long, label int, frozen boolean").cache()
    energy = lambda x: refine.energy(x, unary, nbrs, 2.0).first()["energy"]
    after, moves = cleanup.resolve_conflicts(labels, unary, nbrs, 2.0, boost=1.0)
    assert moves > 0 and energy(after) < energy(labels)
    frozen = lambda x: {r["cell_id"]: r["label"] for r in x.where("frozen").collect()}
    assert frozen(after) == frozen(labels)
    count = lambda x: refine.violations(pairs, x, 0.1, 0.4).agg(F.sum("n_violations").alias("n")).first()["n"] or 0
    last, moved, lost = cleanup.clear_residuals(after, unary, nbrs)
    assert frozen(last) == frozen(labels) and count(last) <= count(after) and moved + lost > 0
    # What is left among cells that are free has no label to go to.
    assert last.where("label < -1").count() == 0


def test_joint_moves_of_groups_are_those_of_all_cells(spark, monkeypatch):
    """Small connected groups need no rounds of joins, and whatever is made in tasks the moves are the same; some cells lack costs or a label."""
    rng = np.random.default_rng(6)
    n = 160
    near = [(i, j, float(rng.integers(-2, 9)) / 8) for i in range(n) for j in range(i + 1, min(i + 5, n)) if i // 40 == j // 40 or (i // 40, j // 40) == (0, 1)]
    nbrs = spark.createDataFrame([e for i, j, w in near for e in ((i, j, w), (j, i, w))], "i long, j long, w double")
    unary = spark.createDataFrame([(i, [float(rng.integers(0, 9)) / 4 for _ in range(4)]) for i in range(n) if i % 29], "cell_id long, costs array<double>")
    labels = spark.createDataFrame([(i, int(rng.integers(0, 2)) if i % 23 else -1, bool(i % 5 == 0)) for i in range(n)], "cell_id long, label int, frozen boolean")
    given = {"rounds": 2, "boost_weight": 0.5}
    of = lambda got: ({tuple(r) for r in got[0].collect()}, got[1])
    joins, mixed = of(cleanup.resolve_conflicts(labels, unary, nbrs, 1.5, **given, group_cells=0)), of(cleanup.resolve_conflicts(labels, unary, nbrs, 1.5, **given, group_cells=50))

    def never(*args):
        raise AssertionError("rounds of joins over small groups")

    monkeypatch.setattr(cleanup, "_joint_moves", never)
    assert joins == mixed == of(cleanup.resolve_conflicts(labels, unary, nbrs, 1.5, **given)) and joins[1] > 10 and len(joins[0]) == n
    assert of(cleanup.resolve_conflicts(labels, unary, nbrs.limit(0), 1.5))[1] == 0


def test_calibration(spark, field):
    pairs = mosaic.coverage_map(field, 20.0)
    labels = field.select("cell_id", F.col("y").alias("label"), (F.col("cell_id") % 3 > 0).alias("frozen"))
    assert mixture_threshold(pairs) is not None and mixture_threshold(pairs.limit(5)) is None
    assert tau_of_frozen(pairs, labels, least_pairs=1).where("tau < 0.01 or tau > 0.49").count() == 0
    unary = field.select("cell_id", F.array(F.lit(0.0), F.lit(2.0), F.lit(5.0)).alias("costs"))
    r = penalty_weight(pairs, labels, unary, 0.0, least=1, most_broken=1.0).first()
    assert r["gap"] == 2.0 and (r["lam"] is None or r["lam"] == pytest.approx(2.0 / r["push"]))
    assert diag.compact(spark.createDataFrame([(1, 7), (2, -1), (3, 4)], "cell_id long, label int")).orderBy("cell_id").select("label").collect() == [(1,), (-1,), (0,)]


@pytest.mark.parametrize(
    "options",
    [
        {"cleanups": 2},
        {"split_merge": True, "n_start": 5, "hard": 0.85, "cleanups": 1},
        pytest.param({"sequential": False, "covariance": "diag", "quality_gate": 0.5, "mixture": True, "adaptive_boost": True, "refits": 0, "cleanups": 0}, marks=pytest.mark.xfail(reason="open fault: with synchronous sweeps and these estimates the ARI bound isn't met on this field")),
    ],
)
def test_strategy(spark, field, options):
    truth = field.select("cell_id", "y")
    plain = metrics.adjusted_rand(mosaic.diag.frozen_by_posterior(estimators.mixture_unary(field, estimators.fit_mixture(field, estimators.initial_means(field, 3))), 0.9).join(truth, "cell_id")).first()["ari"]
    got = mosaic.MosaicStrategy.from_config({"n_clusters": 3, "radius": 20.0} | options).fit(field)
    assert got.model["violations_after"] <= got.model["violations_before"]
    labels = got.labels.join(truth, "cell_id")
    assert labels.count() == field.count() and metrics.adjusted_rand(labels.where("label >= 0")).first()["ari"] >= plain - 0.03
    with pytest.raises(ValueError):
        mosaic.MosaicStrategy.from_config({"n_clusters": 3, "radios": 1})


def test_synchronous_strategy_against_its_own_mixture(spark, field):
    """Synchronous sweeps don't fall below the mixture that they start from, even where the gate's fixed thresholds pull types together."""
    truth = field.select("cell_id", "y")
    got = mosaic.MosaicStrategy(3, radius=20.0, sequential=False, covariance="diag", quality_gate=0.5, mixture=True, refits=0, cleanups=0).fit(field)
    ari = lambda x: metrics.adjusted_rand(x.join(truth, "cell_id")).first()["ari"]
    assert [n for n, _ in got.model["stages"]] == ["mixture", "refined"] and ari(got.labels) >= ari(got.model["first"]) - 0.01
    value = lambda x: refine.energy(x, got.model["unary"], got.model["nbrs"], got.model["lam"]).first()["energy"]
    assert value(got.labels) <= value(refine.icm_jacobi(got.model["first"], got.model["unary"], got.model["nbrs"], got.model["lam"], 10))
