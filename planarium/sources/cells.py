"""Cell tables: cell_id, cx, cy, label, clipped, poly and optional features."""

from __future__ import annotations

import io
import math
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planarium.functions.geometry import counter_clockwise, hull_features, point, vertex_mean

SCHEMA = "cell_id long, `group` int, cx double, cy double, clipped boolean, poly array<struct<x:double,y:double>>, features array<double>, y int"


def hexagon(x: Column, y: Column, r: Column) -> Column:
    return F.array(*(point(x + r * math.cos(k * math.pi / 3), y + r * math.sin(k * math.pi / 3)) for k in range(6)))


#: Parts of a task; their cells are a hundred times as much work as their few bytes tell.
PARTS_A_TASK = 4096


def from_parts(part: DataFrame) -> DataFrame:
    """A field of hexagonal cells derived from a parts table; its density is the same at every size.

    Parts are dealt anew by key, to a number of tasks that follows their count: a file of a few MB is one task's,
    and without a number adaptive execution would join the small partitions to one again.
    """
    tasks = max(2, -(-part.count() // PARTS_A_TASK))
    part = part.repartition(tasks, "p_partkey").select("p_partkey", "p_size")
    tile = F.floor(F.col("p_partkey") / 2000.0).cast("int")
    cells = part.select(
        F.col("p_partkey").alias("cell_id"),
        ((F.col("p_partkey") * 37 % 1009).cast("double") / 10 + 110 * (tile % 4)).alias("cx"),
        ((F.col("p_partkey") * 91 % 997).cast("double") / 10 + 110 * F.floor(tile / 4.0).cast("int")).alias("cy"),
        (2.0 + (F.col("p_size") % 7).cast("double") / 4).alias("r"),
        (F.col("p_partkey") % 5).cast("int").alias("label"), (F.col("p_partkey") % 11 == 0).alias("clipped"),
    )
    return cells.withColumn("poly", hexagon(F.col("cx"), F.col("cy"), F.col("r")))


def ingest(rows: DataFrame, features: list[str], polygon: str = "hull_points", group: str = "celltype_final", center: bool = True, normalize: bool = False, key: str | None = None) -> DataFrame:
    """Cells from a table of hulls: rows without a group go, groups become dense ids in sorted order, centres are vertex means.

    Features are centred and, with `normalize`, divided by their population
    standard deviation (0 counts as 1).  Fewer than two features are an error.
    Rings come out counter-clockwise.  `key` names a column of unique ids; without
    it cells are numbered as they are read, so write the result before using it twice.
    """
    if len(features) < 2:
        raise ValueError("at least two feature columns are needed")
    rows = rows.where(F.col(group).isNotNull())
    # Groups are few: their ids come from the distinct values, not from a window over all rows.
    names = rows.select(F.col(group).alias("_name")).distinct().withColumn("_id", F.dense_rank().over(Window.orderBy("_name")) - 1)
    stats = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features)).first()
    value = lambda c: (F.col(c).cast("double") - (stats[f"m_{c}"] or 0.0 if center else 0.0)) / ((stats[f"s_{c}"] or 1.0) if normalize else 1.0)
    mean = vertex_mean(F.col(polygon))
    clipped = F.col("clipped") if "clipped" in rows.columns else F.lit(False)
    out = rows.join(F.broadcast(names), F.col(group) == F.col("_name"))
    return out.select((F.col(key).cast("long") if key else F.monotonically_increasing_id()).alias("cell_id"), F.col("_id").cast("int").alias("group"), mean["x"].alias("cx"), mean["y"].alias("cy"), clipped.alias("clipped"), counter_clockwise(F.col(polygon)).alias("poly"), F.array(*map(value, features)).alias("features"), F.col("_id").cast("int").alias("y"), hull_features(F.col(polygon)).alias("hull"))


def save(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """The flat archive form (vertices and offsets), for exchange of single small sets."""
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect())
    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
        offsets, v = z["polygon_offsets"], z["polygon_vertices"]
        rows = [
            (i, int(z["groups"][i]), float(z["centers"][i, 0]), float(z["centers"][i, 1]), bool(z["clipped"][i]), [(float(a), float(b)) for a, b in v[offsets[i] : offsets[i + 1]]], [float(x) for x in z["X"][i]], int(z["y"][i]))
            for i in range(len(z["groups"]))
        ]
    return spark.createDataFrame(rows, SCHEMA)


def write_npz(cells: DataFrame, path: str) -> None:
    """The inverse of read_npz, on the driver: for sets that fit there."""
    rows = cells.orderBy("cell_id").collect()
    polys = [np.array([[p["x"], p["y"]] for p in r["poly"] or []], dtype=float).reshape(-1, 2) for r in rows]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    np.savez_compressed(
        path, groups=np.array([r["group"] for r in rows]), centers=np.array([[r["cx"], r["cy"]] for r in rows]), clipped=np.array([r["clipped"] for r in rows]), polygon_vertices=np.concatenate(polys) if polys else np.zeros((0, 2)),
        polygon_offsets=np.concatenate([[0], np.cumsum([len(p) for p in polys])]).astype(np.int64), X=np.array([r["features"] for r in rows]), y=np.array([r["y"] for r in rows]),
    )
