"""Exact quantiles of groups that need not fit in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarium.sources.store import shuffled, written

#: Groups whose cuts (2 kB each) and ranks every task may have.
FEW_GROUPS = 2048


def exact_quantiles(rows: DataFrame, value: str, qs: list[float], by: list[str] | None = None, parts: int = 256) -> DataFrame:
    """Rows (*by, n, q_0, q_1, ...): quantiles with linear interpolation; nulls are left out, a group of nulls has no row.

    A mergeable sketch cuts each group into about `parts` stretches; their exact
    counts tell which stretches hold the two ranks that a quantile lies
    between, and only the distinct values of those, with their counts, are
    ordered.  A value may repeat as often as it likes.
    """
    by = by or []
    # The values alone are written once: what makes them may be costly and is read three times here.
    rows = written(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), "values")
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", [(i + 1) / parts for i in range(parts - 1)], 10 * parts)).alias("_cuts"))
    cuts = written(cuts, "cuts")
    # Spark takes the array of cuts for larger than the file of values, and would send the values through the driver.
    few = F.broadcast if not by or cuts.count() <= FEW_GROUPS else shuffled
    at = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    on = same[0] if by else F.lit(True)
    for c in same[1:]:
        on = on & c
    # One row of cuts for each group.
    placed = rows.alias("a").join(few(cuts).alias("b"), on).select(*(F.col(f"a.{c}").alias(c) for c in by), "_v", at.alias("_part"))
    values = placed.groupBy(*by, "_part", "_v").agg(F.count("*").alias("_n"))
    counts = values.groupBy(*by, "_part").agg(F.sum("_n").alias("_n"))
    stretches = counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("_parts"))

    def holder(rank):
        """The stretch that holds a 0-based rank, and the rows before it."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("before"))
        step = lambda acc, p: F.struct((acc["seen"] + p["_n"]).alias("seen"), F.when((acc["part"] < 0) & (acc["seen"] + p["_n"] > rank), p["_part"]).otherwise(acc["part"]).alias("part"), F.when((acc["part"] < 0) & (acc["seen"] + p["_n"] > rank), acc["seen"]).otherwise(acc["before"]).alias("before"))
        return F.aggregate("_parts", start, step)

    wanted = []
    for i, q in enumerate(qs):
        exact = F.round(F.lit(float(q)) * (F.col("n") - 1), 7)  # so that q = r / (n - 1) means rank r
        for side, rank in (("lo", F.floor(exact)), ("hi", F.ceil(exact))):
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), (exact - F.floor(exact)).alias("share"), holder(rank).alias("h")))
    asked = stretches.select(*by, "n", F.explode(F.array(*wanted)).alias("w")).select(*by, "n", "w.i", "w.side", "w.rank", "w.share", F.col("w.h.part").alias("_part"), F.col("w.h.before").alias("before"))
    on = F.col("a._part") == F.col("b._part")
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    near = few(asked).alias("a").join(values.alias("b"), on).select(*(F.col(f"a.{c}").alias(c) for c in by), "n", "i", "side", "rank", "share", "before", F.struct("_v", "_n").alias("x"))
    lists = near.groupBy(*by, "n", "i", "side", "rank", "share", "before").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    pick = F.aggregate("xs", F.struct(F.col("before").alias("seen"), F.lit(None).cast("double").alias("v")), lambda acc, x: F.struct((acc["seen"] + x["_n"]).alias("seen"), F.when(acc["v"].isNull() & (acc["seen"] + x["_n"] > F.col("rank")), x["_v"]).otherwise(acc["v"]).alias("v")))
    got = lists.select(*by, "n", "i", "side", "share", pick["v"].alias("v"))
    value_of = lambda i, side: F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("v")))
    share_of = lambda i: F.max(F.when(F.col("i") == i, F.col("share")))
    return got.groupBy(*by, "n").agg(*((value_of(i, "lo") + share_of(i) * (value_of(i, "hi") - value_of(i, "lo"))).alias(f"q_{i}") for i in range(len(qs))))
