"""Weighted graphs as edge tables: symmetrising, repulsion, cluster connectivity, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.functions.ramps import ramp, rbf
from planarium.operators.pairs import knn
from planarium.operators.quantiles import exact_quantiles
from planarium.sources.store import dropped, shuffled, written


#: Edges of a graph whose rounds run in one task.
FEW_EDGES = 200_000


def both_ways(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """Each undirected edge in both directions, from one pass over the edges."""
    rest = [c for c in edges.columns if c not in (a, b)]
    ends = F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b"))))
    return edges.select(ends.alias("ends"), *rest).select(F.col("ends.a").alias(a), F.col("ends.b").alias(b), *rest)


def feature_graph(points: DataFrame, k: int, **kwargs) -> DataFrame:
    """Symmetric edges (src, dst, w): Gaussian weights of the k-nearest graph, the larger of both directions.

    The width is the median of all neighbour distances, 1 if that is 0.
    """
    near = written(knn(points, k, **kwargs), "near")
    sigma = (exact_quantiles(near.select(F.sqrt("d2").alias("d")), "d", [0.5]).first() or [None, 1.0])["q_0"] or 1.0
    w = near.select("src", "dst", rbf(F.col("d2"), sigma).alias("w"))
    return both_ways(w, "src", "dst").groupBy("src", "dst").agg(F.max("w").alias("w"))


def repulsed(graph: DataFrame, pairs: DataFrame, tau: DataFrame, high: float, strength: float = 0.0) -> DataFrame:
    """Edges (src, dst, w) weakened where the two cells overlap.

    pairs (i, j, cf); tau (cell_id, tau).  The lower threshold is the mean of
    both cells'.  Without `strength` a weight is scaled by 1 - ramp, with it
    strength * ramp is taken off, down to 0.  Other edges stay as they are.
    """
    cf = both_ways(pairs.select("i", "j", "cf")).select(F.col("i").alias("src"), F.col("j").alias("dst"), "cf")
    t = lambda c: shuffled(tau).select(F.col("cell_id").alias(c), F.col("tau").alias(f"tau_{c}"))
    rows = graph.join(shuffled(cf), ["src", "dst"], "left").join(t("src"), "src", "left").join(t("dst"), "dst", "left")
    r = ramp(F.col("cf"), (F.col("tau_src") + F.col("tau_dst")) / 2, high)
    w = F.greatest(F.lit(0.0), F.col("w") - strength * r) if strength else F.col("w") * (1 - r)
    return rows.select("src", "dst", F.when(F.col("cf").isNull(), F.col("w")).otherwise(w).alias("w"))


def paga(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (a, b, weight), a < b: edge weight between clusters over the root of both total strengths."""
    l = lambda c: shuffled(labels).select(F.col("cell_id").alias(c), F.col("label").alias(f"l_{c}"))
    sums = graph.join(l("src"), "src").join(l("dst"), "dst").groupBy(F.col("l_src").alias("a"), F.col("l_dst").alias("b")).agg(F.sum("w").alias("w"))
    sums = written(sums, "sums")
    strength = sums.groupBy("a").agg(F.sum("w").alias("s"))
    s = lambda c: strength.select(F.col("a").alias(c), F.col("s").alias(f"s_{c}"))
    norm = F.sqrt(F.col("s_a") * F.col("s_b"))
    return sums.where("a < b").join(s("a"), "a").join(s("b"), "b").select("a", "b", F.when(norm > 0, F.col("w") / F.nullif(norm, F.lit(0.0))).otherwise(0.0).alias("weight"))


def stars(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: rows (node, root), root the smallest node of the component.

    Alternates the large-star and small-star rewiring steps (Kiveris et al.,
    2014) until no edge changes; more than `most_rounds` rounds are an error.
    Each half round is one grouped minimum, so a hub is pre-aggregated before it
    is shuffled, and each round is written, so plans don't grow.  Nodes without
    an edge are absent.  Null ends and self loops are ignored; no edges give no
    rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, before = written(e, "edges"), None
    for _ in range(most_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
        # A round over few edges is one task without any shuffle; one over more never sends its nodes through the driver.
        few = now["n"] <= FEW_EDGES
        both, met = both_ways(e.coalesce(1) if few else e, "u", "v"), (lambda df: df) if few else shuffled
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(met(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(met(low), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        after = written(small, "edges")
        dropped(e)
        e = after
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (cell_id, component): the smallest id that undirected edges (i, j) reach; a node without edges is its own."""
    roots = stars(edges, "i", "j").withColumnRenamed("node", "cell_id")
    return nodes.select("cell_id").join(shuffled(roots), "cell_id", "left").select("cell_id", F.coalesce("root", "cell_id").alias("component"))
