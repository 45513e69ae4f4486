"""What must hold so that tables far larger than those of the tests pass too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarium.operators import calibrate, diagnostics, estimators, graph, pairs, quantiles, refine
from planarium.plans import catalogue
from planarium.sources import cells as source


QUERIES_OVER_PAIRS = ["label_push", "label_scores", "merge_boundary", "merge_gates", "mrf_energy", "neighbour_composition", "violation_count", "ramp_family", "tau_low_per_cluster", "top_neighbour", "quality_gate", "icm_jacobi_sweep", "energy_gaps", "error_summary", "hard_pair_release"]


@pytest.fixture(scope="module")
def field(spark):
    return source.from_parts(spark.range(1, 200).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_cells_are_never_broadcast(field):
    """Compressed files of a few MB hide a GB of rings, so no join by cell may send a side through the driver."""
    labels = field.select("cell_id", "label", (F.col("cell_id") % 3 == 0).alias("frozen"))
    unary = field.select("cell_id", F.array(*(F.lit(float(k)) for k in range(5))).alias("costs"))
    cf = pairs.coverage_map(field, 8.0)
    nbrs = refine.neighbours(cf, 0.1, 0.4)
    tau = labels.select("cell_id", F.lit(0.1).alias("tau"))
    edges = pairs.proximity_map(field, 8.0).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("score").alias("w"))
    for df in (
        cf, edges, calibrate.label_push(cf, labels, 0.1), calibrate.merge_gates(cf, labels, 0.4), refine.violations(cf, labels, 0.1, 0.4), refine.label_scores(nbrs, labels), refine.jacobi_sweep(labels, unary, nbrs, 2.0),
        diagnostics.quality(cf, labels), diagnostics.energy_gaps(labels, unary, nbrs, 2.0), diagnostics.neighbour_shares(nbrs, labels), diagnostics.unfrozen_hard_pairs(labels, cf, 0.85), graph.repulsed(edges, cf, tau, 0.7),
    ):
        assert "BroadcastHashJoin" not in plan(df)


def test_cells_are_dealt_anew_by_key(spark, field):
    """One small file of parts must not make all rings, hulls and pairs the work of one task."""
    assert "hashpartitioning(p_partkey" in plan(source.from_parts(field.sparkSession.range(1, 9, 1, 1).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size"))))


def test_adaptive_execution_leaves_the_deal_of_parts(spark):
    """The parts of a task are bounded, though their bytes are too few to be worth a task by themselves."""
    parts = spark.range(1, 3 * source.PARTS_A_TASK).select(F.col("id").alias("p_partkey"), F.lit(3).alias("p_size"))
    assert source.from_parts(parts).rdd.getNumPartitions() == 3


def test_blocks_of_near_points_grow_with_the_table(spark, monkeypatch):
    """The number of blocks, and with it how often each point is exchanged, is bounded; neighbours stay exact, ties and copies too."""
    monkeypatch.setattr(pairs, "NEAR_BLOCKS", 3)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 6)), 1)
    x[100:110] = x[90:100]
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, features array<double>")
    _, blocks = pairs.dealt_blocks(points, block_rows=8, blocks=3)
    assert blocks.count() <= 8  # 150 / 8 are 19
    d = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    np.fill_diagonal(d, np.inf)
    got = {(r["src"], r["rank"]): (r["dst"], r["d2"]) for r in pairs.knn(points, 4, block_rows=8).collect()}
    want = {(i, k + 1): (int(j), d[i, j]) for i in range(150) for k, j in enumerate(np.lexsort((np.arange(150), d[i]))[:4])}
    assert got == want


def rows_sent(spark, job, kind="BroadcastExchange", metric="number of output rows"):
    """What a job gives, and the rows of the largest table that was sent through the driver meanwhile, or that another kind of node counted."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got, most = job(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(before, runs.size())):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics() if node.name() == kind else None
            for m in (metrics.apply(i) for i in range(metrics.size() if metrics else 0)):
                value = values.get(m.accumulatorId())
                if m.name() == metric and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return got, most


@pytest.mark.parametrize("few", [2048, 2])
def test_quantiles_send_cuts_and_never_values(spark, monkeypatch, few):
    """The array of cuts looks larger to Spark than the file of values, so it used to send the values."""
    monkeypatch.setattr(quantiles, "FEW_GROUPS", few, raising=False)
    rows = spark.range(20_000).select((F.col("id") % 3).cast("int").alias("label"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    got, most = rows_sent(spark, lambda: {r["label"]: (r["n"], r["q_0"], r["q_1"]) for r in quantiles.exact_quantiles(rows, "v", [0.25, 0.9], ["label"]).collect()})
    v = np.arange(20_000) * 7919 % 20_011
    assert got == {k: (len(v[k::3]), pytest.approx(np.quantile(v[k::3], 0.25)), pytest.approx(np.quantile(v[k::3], 0.9))) for k in range(3)}
    assert most <= 12  # a row for each group and rank


def test_components_of_many_edges_send_nothing(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", 100)
    edges = spark.range(3000).where("id % 10 <> 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got, most = rows_sent(spark, lambda: {r["node"]: r["root"] for r in graph.stars(edges).collect()})
    assert got == {i: i // 10 * 10 for i in range(3000)} and most <= 200  # of the last rounds, should they be small


def test_cluster_means_send_no_labels(spark):
    points = spark.range(4000).select(F.col("id").alias("cell_id"), F.array(F.col("id").cast("double")).alias("features"))
    labels = spark.range(4000).select(F.col("id").alias("cell_id"), (F.col("id") % 2).cast("int").alias("label"))
    got, most = rows_sent(spark, lambda: {r["label"]: r["mean"] for r in estimators.cluster_means(points, labels).collect()})
    assert got == {0: [1999.0], 1: [2000.0]} and most == 0


@pytest.mark.parametrize("name", QUERIES_OVER_PAIRS)
def test_queries_over_pairs_send_no_cells(spark, tmp_path, name):
    """The whole query as registered: ranks and single rows may pass through the driver, a row for each cell or pair may not."""
    spark.range(400).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    _, most = rows_sent(spark, lambda: catalogue.QUERIES[name](spark, str(tmp_path)).collect())
    assert most <= 12


def test_near_points_travel_by_groups(spark, monkeypatch):
    """A point is exchanged once for each of a few groups, not for each block; neighbours stay exact."""
    monkeypatch.setattr(pairs, "NEAR_GROUPS", 3, raising=False)
    x = np.round(np.random.default_rng(8).normal(size=(400, 8)), 2)
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, features array<double>")
    d = np.round(((x[:, None] - x[None]) ** 2).sum(axis=2), 9)
    np.fill_diagonal(d, np.inf)
    got, most = rows_sent(spark, lambda: {(r["src"], r["rank"]): r["dst"] for r in pairs.knn(points, 3, block_rows=8).collect()}, "Exchange", "shuffle records written")
    assert got == {(i, k + 1): int(j) for i in range(400) for k, j in enumerate(np.lexsort((np.arange(400), d[i]))[:3])}
    assert 400 <= most <= 400 * 3 * 3  # k candidates of a point for each group that it meets, and its own block's
