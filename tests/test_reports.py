"""Settled sweeps, traces of stages, and batch jobs."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarium.operators import refine, reports
from planarium.plans import jobs

LABELS, UNARY, NBRS = "cell_id long, label int, frozen boolean", "cell_id long, costs array<double>", "i long, j long, w double"


def both(edges):
    return [r for i, j, w in edges for r in ((i, j, w), (j, i, w))]


def test_settled_sweeps_where_plain_ones_swing(spark):
    """A square of repelling cells, all alike: plain sweeps swing between two labelings for ever."""
    edges = both([(a, b, 1.0) for a, b in itertools.combinations(range(4), 2)])
    labels, unary, nbrs = spark.createDataFrame([(i, 0, False) for i in range(4)], LABELS), spark.createDataFrame([(i, [0.0, 0.0]) for i in range(4)], UNARY), spark.createDataFrame(edges, NBRS)
    value = lambda x: refine.energy(x, unary, nbrs, 1.0).first()["energy"]
    assert value(refine.icm_jacobi(labels, unary, nbrs, 1.0, 5)) == 6.0
    assert value(refine.icm_settled(labels, unary, nbrs, 1.0)) == 2.0


def test_settled_sweeps_against_single_moves(spark):
    rng = np.random.default_rng(8)
    n, k, lam = 40, 3, 2.0
    edges = [(int(a), int(b), round(float(rng.normal(0.3, 1)), 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.15]
    costs, frozen = rng.random((n, k)).round(3), [i % 6 == 0 for i in range(n)]
    start = [int(x) for x in rng.integers(-1, k, n)]
    labels = spark.createDataFrame([(i, start[i], frozen[i]) for i in range(n)], LABELS)
    unary, nbrs = spark.createDataFrame([(i, costs[i].tolist()) for i in range(n)], UNARY), spark.createDataFrame(both(edges), NBRS)
    got = {r["cell_id"]: r["label"] for r in refine.icm_settled(labels, unary, nbrs, lam, 200).collect()}
    assert len(got) == n and all(got[i] == start[i] for i in range(n) if frozen[i])
    near = {i: [(b if a == i else a, w) for a, b, w in edges if i in (a, b)] for i in range(n)}
    for i in range(n):
        local = [costs[i][c] + lam * sum(w for j, w in near[i] if got[j] == c) for c in range(k)]
        assert frozen[i] or local[got[i]] <= min(local) + 1e-8
    none = refine.icm_settled(labels.limit(0), unary, nbrs, lam)
    assert none.count() == 0


def test_stage_trace(spark):
    truth = spark.createDataFrame([(i, i % 3 if i < 12 else None) for i in range(14)], "cell_id long, y int")
    first = spark.createDataFrame([(i, (i + 1) % 3) for i in range(14)], "cell_id long, label int")
    second = spark.createDataFrame([(i, None if i == 0 else -1 if i == 1 else 9 if i == 2 else i % 3) for i in range(12)], "cell_id long, label int").withColumn("y", F.lit(5))
    got = {r["stage"]: r for r in reports.stage_trace([("a", first), ("b", second)], truth).collect()}
    a, b = got["a"], got["b"]
    assert (a["step"], a["cells"], a["clusters"], a["unlabelled"], a["errors"], a["ari"]) == (0, 12, 3, 0, 0, 1.0)
    assert (b["step"], b["cells"], b["clusters"], b["unlabelled"], b["errors"]) == (1, 12, 4, 2, 1) and 0 < b["ari"] < 1
    open_ = reports.stage_trace([("none", first.withColumn("label", F.lit(-1)))], truth).first()
    assert (open_["unlabelled"], open_["errors"], open_["clusters"], open_["ari"]) == (12, 0, 0, None)
    with pytest.raises(ValueError):
        reports.stage_trace([], truth)


class Fixed:
    def __init__(self, labels, **model):
        self.labels, self.model = labels, model

    def fit(self, cells):
        return self


def test_comparison_and_variants(spark):
    truth = spark.createDataFrame([(i, i % 2) for i in range(8)], "cell_id long, y int")
    labels = truth.withColumnRenamed("y", "label")
    got = {r["strategy"]: r for r in reports.compared(truth, truth, {"one": Fixed(labels, violations_before=3, violations_after=1), "two": Fixed(labels.withColumn("label", F.lit(0)))}).collect()}
    assert (got["one"]["ari"], got["one"]["violations_before"], got["one"]["violations_after"]) == (1.0, 3, 1)
    assert (got["two"]["errors"], got["two"]["violations_after"]) == (4, None) and got["two"]["ari"] == 0.0
    assert list(reports.strategies(3, 5.0)) == ["mixture", "communities", "communities_by_distance", "ward", "ward_penalty", "mosaic"]
    v = reports.ramp_variants(3, 5.0, refits=0)
    assert [(s.signed, s.log, s.hard, s.low, s.refits) for s in v.values()] == [(False, False, None, None, 0), (True, False, None, 0.3, 0), (True, True, None, 0.3, 0), (True, True, 0.75, 0.3, 0)]


def hulls(spark):
    """Two interleaved grids of hexagons, of two types that features tell apart, and one row without a type."""
    rng, rows = np.random.default_rng(2), []
    for k in (0, 1):
        for a, b in itertools.product(range(5), range(5)):
            x, y = a * 10 + 5 * k + rng.normal(0, 0.2), b * 10 + 5 * k + rng.normal(0, 0.2)
            rows.append((len(rows) * 3, "xy"[k], [(x + 5 * math.cos(-t * math.pi / 3), y + 5 * math.sin(-t * math.pi / 3)) for t in range(6)], float(rng.normal(3 * k, 0.4)), float(rng.normal(0, 0.4))))
    rows.append((999, None, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], 0.0, 0.0))
    return spark.createDataFrame(rows, "id long, celltype_final string, hull_points array<struct<x:double,y:double>>, f double, g double")


def test_batch_job(spark, tmp_path):
    table = str(tmp_path / "hulls")
    hulls(spark).write.parquet(table)
    (tmp_path / "b.yaml").write_text(json.dumps({"input": {"path": table, "feature_cols": ["f", "g"], "key": "id"}, "fit": {"covariance": "diag", "sequential": False, "refits": 0, "cleanups": 0, "low": 0.05, "high": 0.4}, "output": {"name": "plain"}}))
    traces = jobs.run_folder(spark, str(tmp_path), str(tmp_path / "out"))
    rows = traces[0].orderBy("step").collect()
    assert len(traces) == 1 and [r["stage"] for r in rows] == ["mixture", "refined", "end"] and {r["job"] for r in rows} == {"plain"}
    assert all(r["cells"] == 50 and r["clusters"] == 2 for r in rows) and rows[-1]["ari"] >= rows[0]["ari"] - 0.01
    labels = spark.read.parquet(str(tmp_path / "out" / "plain" / "labels"))
    assert labels.count() == 50 and {r["cell_id"] for r in labels.collect()} == {3 * i for i in range(50)}
    cells = jobs.cells_of(spark, jobs.read_config(spark, str(tmp_path / "b.yaml")))
    assert 18 < reports.spacing(cells) < 24 and reports.spacing(cells.limit(1)) == 0.0


def test_configurations(spark, tmp_path):
    assert jobs.read_config(spark, str(tmp_path / "none.yaml")) == {}
    for name, text in (("empty", ""), ("list", "[1, 2]"), ("flat", '{"n_clusters": 4, "start_factor": 2, "covariance": "diag"}')):
        (tmp_path / f"{name}.yaml").write_text(text)
    assert jobs.read_config(spark, str(tmp_path / "empty.yaml")) == {}
    with pytest.raises(ValueError):
        jobs.read_config(spark, str(tmp_path / "list.yaml"))
    s = jobs.strategy_of(jobs.read_config(spark, str(tmp_path / "flat.yaml")), 7, 9.0)
    assert (s.n_clusters, s.n_start, s.radius, s.covariance, s.start) == (4, 8, 9.0, "diag", "kmeans")
    assert callable(jobs.strategy_of({"start": "communities", "community_k": 5}, 3, 9.0).start) and callable(jobs.strategy_of({"start": "ward"}, 3, 9.0).start)
    with pytest.raises(ValueError):
        jobs.strategy_of({"misspelt": 1}, 3, 9.0)
    with pytest.raises(ValueError):
        jobs.run_job(spark, str(tmp_path / "flat.yaml"), str(tmp_path))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        jobs.run_folder(spark, str(tmp_path / "none"), str(tmp_path))
