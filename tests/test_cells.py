"""Planar cell operators on hand-made cells and against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarium.functions import geometry as g
from planarium.functions import ramps
from planarium.operators import graph, metrics, pairs, raster, refine
from planarium.sources import cells as source

POLY = "poly array<struct<x:double,y:double>>"


def square(x=0.0, y=0.0, s=1.0):
    return [(float(a), float(b)) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]


def one(spark, poly, **columns):
    r = spark.createDataFrame([(poly,)], POLY).select(*(c.alias(n) for n, c in columns.items())).first()
    return r[0] if len(columns) == 1 else r


def test_polygon_scalars(spark):
    p = F.col("poly")
    r = one(spark, square(), a=g.area(p), h=g.hull_features(p), c=g.centroid(p), m=g.vertex_mean(p), d=g.equivalent_diameter(p))
    assert r["a"] == 1 and r["h"]["perimeter"] == 4 and r["h"]["circularity"] == pytest.approx(math.pi / 4) and tuple(r["c"]) == (0.5, 0.5) == tuple(r["m"]) and r["d"] == pytest.approx(2 / math.sqrt(math.pi))
    r = one(spark, [(0.0, 0.0), (1.0, 1.0)], h=g.hull_features(p), c=g.centroid(p))
    assert math.isnan(r["h"]["area"]) and math.isnan(r["c"]["x"])
    assert one(spark, square()[::-1], a=g.signed_area(g.counter_clockwise(p))) == 1


def test_clipping_and_overlap(spark):
    p = F.col("poly")
    assert one(spark, square(-1, -1, 4), a=g.area(g.clipped_to_box(p, (0.0, 2.0, 0.0, 2.0)))) == 4
    assert one(spark, square(5, 5), c=g.clipped_to_box(p, (0.0, 2.0, 0.0, 2.0))) is None
    assert one(spark, square(1, 1, 4), a=g.area(g.clamped(p, (0.0, 2.0, 0.0, 2.0)))) == 1
    two = spark.createDataFrame([(square(), square(0.5, 0.0)), (square(), square(1, 0)), (square(0, 0, 3), square(1, 1))], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert [r[0] for r in two.select(F.round(g.area(g.intersection(F.col("a"), F.col("b"))), 9)).collect()] == [0.5, 0, 1]
    grown = one(spark, square(), a=g.area(g.dilated(p, 0.1)))
    r = 0.2 / math.sqrt(math.pi)
    assert grown == pytest.approx(1 + 4 * r + math.pi * r * r, rel=1e-3)
    corner = one(spark, [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0), (2.0, 2.0)], c=F.size(g.with_corner(p, F.lit(0.9), F.lit(0.9), (0.0, 9.0, 0.0, 9.0))))
    assert corner == 5


def test_ramps(spark):
    s = F.col("s")
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.25, 0.4, 1.0)], "s double")
    cols = [ramps.ramp(s, 0.1, 0.4), ramps.signed_ramp(s, 0.1, 0.4), ramps.log_ramp(s, 0.1), ramps.signed_log_ramp(s, 0.1), ramps.ramp(s, 0.4, 0.4)]
    got = np.array([list(r) for r in rows.select(*(c.alias(str(i)) for i, c in enumerate(cols))).collect()], float)
    assert np.allclose(got[:, 0], [0, 0, 0.5, 1, 1]) and np.allclose(got[:, 1], [-1, 0, 0.5, 1, 1]) and np.allclose(got[:, 4], [0, 0, 0, 0, 1])
    assert np.allclose(got[2:, 2], np.log1p(10 * (np.array([0.25, 0.4, 0.99]) - 0.1)) / np.log1p(9)) and got[0, 3] == -1
    r = spark.createDataFrame([([2.0, 1.0, 1.0],)], "c array<double>").select(ramps.argmin(F.col("c")).alias("k"), ramps.posterior(F.col("c")).alias("p"), ramps.joint_cost(F.col("c")).alias("j")).first()
    e = np.exp([-2.0, -1.0, -1.0])
    assert r["k"] == 1 and np.allclose(r["p"], e / e.sum()) and r["j"] == pytest.approx(-math.log(e.sum()))


def field(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, float(x), float(y), bool(i % 7 == 0), int(i % 3)) for i, (x, y) in enumerate(rng.random((n, 2)) * 30)]
    return spark.createDataFrame(rows, "cell_id long, cx double, cy double, clipped boolean, label int"), np.array([r[1:3] for r in rows]), rows


def test_pairs_against_numpy(spark):
    cells, xy, rows = field(spark)
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 3}
    assert {(r["i"], r["j"]) for r in pairs.spatial_pairs(cells, 3.0).collect()} == want
    open_ = {(i, j) for i, j in want if i % 7 and j % 7}
    assert {(r["i"], r["j"]) for r in pairs.proximity_map(cells, 3.0).collect()} == open_
    np.fill_diagonal(d, np.inf)
    near = {r["cell_id"]: r["nn_d"] for r in pairs.nearest_distance(cells, start=0.2).collect()}
    assert np.allclose([near[i] for i in range(150)], d.min(axis=1))
    points = cells.withColumn("features", F.array("cx", "cy"))
    got = {(r["src"], r["rank"]): r["dst"] for r in pairs.knn(points, 4, block_rows=40).collect()}
    order = np.argsort(np.round(d**2, 9), axis=1, kind="stable")
    assert got == {(i, k + 1): order[i, k] for i in range(150) for k in range(4)}


def test_components_and_refinement(spark):
    cells, xy, _ = field(spark, 120, 3)
    near = pairs.spatial_pairs(cells, 2.0)
    edges = [(r["i"], r["j"]) for r in near.collect()]
    root = list(range(120))
    for _ in range(120):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["cell_id"]: r["component"] for r in graph.components(cells.select("cell_id"), near).collect()} == dict(enumerate(root))
    rng = np.random.default_rng(1)
    costs = rng.random((120, 3)).round(3)
    weight = {e: float(rng.random().__round__(3)) for e in edges}
    unary = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(costs)], "cell_id long, costs array<double>")
    nbrs = graph.both_ways(spark.createDataFrame([(i, j, w) for (i, j), w in weight.items()], "i long, j long, w double"))
    start = [i % 3 for i in range(120)]
    labels = cells.select("cell_id", "label", (F.col("cell_id") % 4 == 0).alias("frozen"))
    near_of = {i: [] for i in range(120)}
    for (i, j), w in weight.items():
        near_of[i].append((j, w))
        near_of[j].append((i, w))
    label = list(start)
    for _ in range(50):
        changed = 0
        for i in range(120):
            if i % 4:
                e = costs[i].copy()
                for j, w in near_of[i]:
                    e[label[j]] += 2.0 * w
                best = int(np.argmin(e))
                changed += best != label[i]
                label[i] = best
        if not changed:
            break
    got = {r["cell_id"]: r["label"] for r in refine.icm_sequential(labels, unary, nbrs, 2.0).collect()}
    assert got == dict(enumerate(label))
    before = refine.energy(labels, unary, nbrs, 2.0).first()["energy"]
    own = sum(costs[i][start[i]] for i in range(120)) + 2.0 * sum(w for (i, j), w in weight.items() if start[i] == start[j])
    assert before == pytest.approx(own) and refine.energy(refine.icm_sequential(labels, unary, nbrs, 2.0), unary, nbrs, 2.0).first()["energy"] <= before


def test_metrics(spark):
    rows = spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(60)] + [(0, -1)], "y int, label int")
    assert metrics.adjusted_rand(rows.where("label >= 0")).first()["ari"] == 1
    same = metrics.relabelled(rows)
    assert same.where("label >= 0 and y <> label").count() == 0 and same.where("label = -1").count() == 1
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 6):
        gain = rng.integers(0, 20, (n, n)).astype(float)
        pick = metrics.assignment(gain)
        assert sorted(pick) == list(range(n)) and sum(gain[i, pick[i]] for i in range(n)) == metrics.best_agreement(gain)


def test_raster(spark):
    cells = spark.createDataFrame([(square(0, 0, 5),), (square(2.5, 0, 5),)], POLY)
    r = raster.coverage_raster(cells, (0.0, 10.0, 0.0, 10.0), 20)
    s = raster.coverage_stats(r, 20).first()
    assert s["most"] == 2 and s["covered"] == 150 and s["mean"] == pytest.approx(200 / 150) and s["share"] == 150 / 400
    assert raster.coverage_stats(r.where("n > 9"), 20).first()["mean"] == 0


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(square(), "b", 1.0, 2.0), (square(1, 1), "a", 3.0, 4.0), (square(), None, 9.0, 9.0)], "hull_points array<struct<x:double,y:double>>, celltype_final string, f double, g double")
    cells = source.ingest(rows, ["f", "g"], normalize=True)
    got = {r["group"]: r for r in cells.collect()}
    assert sorted(got) == [0, 1] and got[1]["features"] == [-1.0, -1.0] and got[0]["cx"] == 1.5
    with pytest.raises(ValueError):
        source.ingest(rows, ["f"])
    turned = source.ingest(rows.withColumn("hull_points", F.reverse("hull_points")).withColumn("id", F.col("f").cast("long")), ["f", "g"], key="id")
    assert sorted(r["cell_id"] for r in turned.collect()) == [1, 3] and turned.select(g.signed_area(F.col("poly")).alias("a")).where("a <= 0").count() == 0
    source.save(cells.drop("hull"), f"file://{tmp_path}/cells")
    back = source.load(spark, f"file://{tmp_path}/cells")
    source.write_npz(back, str(tmp_path / "deep/cells.npz"))
    again = source.read_npz(spark, f"file://{tmp_path}/deep/cells.npz")
    key = lambda r: (r["group"], r["cx"], r["cy"], r["clipped"], tuple(map(tuple, r["poly"])), tuple(r["features"]), r["y"])
    assert sorted(map(key, again.collect())) == sorted(map(key, back.collect()))
