"""Coverage counts on a pixel grid."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planarium.functions.geometry import following
from planarium.functions.rings import hulls


def extent(cells: DataFrame):
    """One row (x0, x1, y0, y1): bounds of all vertices; zeros without any."""
    v = cells.select(F.explode("poly").alias("p"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return v.agg(z(F.min("p.x")).alias("x0"), z(F.max("p.x")).alias("x1"), z(F.min("p.y")).alias("y0"), z(F.max("p.y")).alias("y1")).first()


def coverage_runs(cells: DataFrame, bounds: tuple[float, float, float, float], columns: int, rows: int | None = None) -> DataFrame:
    """Rows (row, first, last, n): stretches of pixels of one raster row whose centres lie in the same number n > 0 of polygons.

    Each polygon is cut by the middle lines of the rows that it reaches; the
    sorted crossings bound its stretches, for rings of any shape and direction.
    A stretch adds one where it begins and takes it off behind its end, and
    running sums along a row give the counts: no pixel is tested by itself.
    Polygons of fewer than three vertices, or with null or NaN ones, cover nothing.
    """
    x0, x1, y0, y1 = bounds
    rows = rows or columns
    px, py = (x1 - x0) / columns, (y1 - y0) / rows
    known = F.forall("poly", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    end = lambda f: f(F.transform("poly", lambda p: p["y"]))
    middle = lambda y: F.ceil((y - y0) / py - 0.5).cast("int")  # noqa: E731  the first row whose middle is at y or above
    reach = cells.where((F.size("poly") >= 3) & known).select("poly", F.greatest(middle(end(F.array_min)), F.lit(0)).alias("r0"), F.least(middle(end(F.array_max)), F.lit(rows - 1)).alias("r1")).where("r0 <= r1")
    lines = reach.select("poly", F.explode(F.sequence("r0", "r1")).alias("row")).withColumn("y", y0 + (F.col("row") + 0.5) * py)
    edges = F.zip_with("poly", following(F.col("poly")), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cut = F.filter(edges, lambda e: (e["p"]["y"] <= F.col("y")) != (e["q"]["y"] <= F.col("y")))
    xs = F.array_sort(F.transform(cut, lambda e: e["p"]["x"] + (F.col("y") - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"])))
    column = lambda x: F.greatest(F.lit(0), F.least(F.lit(columns), F.ceil((x - x0) / px - 0.5).cast("int")))
    steps = F.transform(xs, lambda x, i: F.struct(column(x).alias("at"), F.when(i % 2 == 0, 1).otherwise(-1).alias("d")))
    deltas = lines.select("row", F.explode(steps).alias("s")).groupBy("row", F.col("s.at").alias("first")).agg(F.sum("s.d").alias("d")).where("d <> 0")
    along = Window.partitionBy("row").orderBy("first")
    runs = deltas.select("row", "first", (F.lead("first").over(along) - 1).alias("last"), F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    return runs.where("n > 0")


def coverage_raster(cells: DataFrame, bounds: tuple[float, float, float, float], columns: int, rows: int | None = None) -> DataFrame:
    """Rows (row, col, n): polygons over each pixel's centre; pixels that none covers are absent."""
    return coverage_runs(cells, bounds, columns, rows).select("row", F.explode(F.sequence("first", "last")).alias("col"), "n")


def hull_raster(cells: DataFrame, bounds: tuple[float, float, float, float], columns: int, rows: int | None = None) -> DataFrame:
    """As coverage_raster, of the convex hull of each cell's vertices; cells without a hull cover nothing.

    The hulls of an Arrow batch are wrapped at once, each of them once.
    """

    def wrap(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([hulls(b.column(0))], ["poly"])

    ring = "array<struct<x: double, y: double>>"
    return coverage_raster(cells.select(F.col("poly").cast(ring).alias("poly")).mapInArrow(wrap, f"poly {ring}"), bounds, columns, rows)


def coverage_stats(raster: DataFrame, columns: int, rows: int | None = None) -> DataFrame:
    """One row (most, mean, std, covered, share) over covered pixels; zeros where none is."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return raster.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), z(F.avg("n")).alias("mean"), z(F.stddev_pop("n")).alias("std"), F.count("*").alias("covered"), (F.count("*") / float(columns * (rows or columns))).alias("share"))
