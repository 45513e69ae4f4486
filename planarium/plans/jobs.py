"""Batch jobs: a configuration file names a table of hulls and the parameters of a fit; labels and report tables are written.

A configuration is YAML (JSON where no YAML reader is installed):

    input: {path: ..., feature_cols: [...], polygon_col: ..., group_col: ..., key: ...}
    fit: {n_clusters: ..., radius: ..., start_factor: 2, start: kmeans, ...}
    output: {name: ...}

Paths may be of any file system that Spark reads.  `python -m planarium.plans.jobs FOLDER OUTPUT` runs all of a folder.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planarium.operators import reports
from planarium.operators.communities import community_start
from planarium.operators.mosaic import MosaicStrategy
from planarium.operators.ward import ward_start
from planarium.sources import cells as source
from planarium.sources.store import written


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def read_config(spark: SparkSession, path: str) -> dict:
    """The mapping in a file; empty for an empty file or one that isn't there, an error if it holds something else."""
    if not _paths(spark, path):
        return {}
    text = spark.read.text(path, wholetext=True).first()
    try:
        from yaml import safe_load as parse
    except ImportError:
        parse = json.loads
    config = (parse(text["value"]) if text and text["value"].strip() else None) or {}
    if not isinstance(config, dict):
        raise ValueError(f"{path} doesn't hold a mapping")
    return config


def cells_of(spark: SparkSession, config: dict) -> DataFrame:
    """Cells of the Parquet table of hulls that config["input"] names, written once."""
    given = config["input"]
    names = {"polygon": given.get("polygon_col", "hull_points"), "group": given.get("group_col", "celltype_final"), "key": given.get("key")}
    options = {k: given[k] for k in ("center", "normalize") if k in given}
    return written(source.ingest(spark.read.parquet(given["path"]), list(given["feature_cols"]), **names, **options), "cells")


def strategy_of(config: dict, n_clusters: int, radius: float) -> MosaicStrategy:
    """The strategy of flat parameters; those in the mapping win over the numbers found from the data.

    `start_factor` times n_clusters is the number of clusters to begin with;
    `start` may also be "communities" (their number is then n_clusters times the
    factor as well, reached by searching the resolution) or "ward".
    """
    given = dict(config)
    factor = given.pop("start_factor", None)
    named = {"communities": community_start(given.pop("community_k", 15)), "ward": ward_start}
    if isinstance(given.get("start"), str):
        given["start"] = named.get(given["start"], given["start"])
    given = {"n_clusters": n_clusters, "radius": radius} | given
    if factor:
        given.setdefault("n_start", int(factor) * given["n_clusters"])
    return MosaicStrategy.from_config(given)


def run_job(spark: SparkSession, path: str, out: str, comparison: bool = False) -> DataFrame:
    """One file's fit: labels, stage trace and (if wanted) a table of the six strategies under out/<name>; gives the trace as read back.

    Without n_clusters there are as many as groups, without a radius it is three
    times the median distance to the nearest cell.  A table without rows is an error.
    """
    config = read_config(spark, path)
    if "input" not in config:
        raise ValueError(f"{path} names no input")
    cells, fit = cells_of(spark, config), dict(config.get("fit") or {})
    groups = cells.select("y").distinct().count()
    if not groups:
        raise ValueError(f"the input of {path} has no cells")
    k, radius = fit.get("n_clusters") or groups, fit.get("radius") or reports.spacing(cells)
    strategy = strategy_of({n: v for n, v in fit.items() if n not in ("n_clusters", "radius")}, k, radius)
    name = (config.get("output") or {}).get("name") or path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
    got, truth = strategy.fit(cells), cells.select("cell_id", "y")
    folder = f"{out.rstrip('/')}/{name}"
    got.labels.select("cell_id", "label").write.mode("overwrite").parquet(f"{folder}/labels")
    reports.stage_trace([*got.model["stages"], ("end", got.labels)], truth).write.mode("overwrite").parquet(f"{folder}/stages")
    if comparison:
        reports.compared(cells, truth, reports.strategies(k, radius, strategy)).write.mode("overwrite").parquet(f"{folder}/strategies")
    return spark.read.parquet(f"{folder}/stages").withColumn("job", F.lit(name))


def run_folder(spark: SparkSession, folder: str, out: str, comparison: bool = False) -> list[DataFrame]:
    """run_job for each *.yaml of a folder in order of their names; none is an error."""
    paths = _paths(spark, f"{folder.rstrip('/')}/*.yaml")
    if not paths:
        raise FileNotFoundError(f"no *.yaml in {folder}")
    return [run_job(spark, p, out, comparison) for p in paths]


if __name__ == "__main__":
    if len(sys.argv) != 3:
        sys.exit("usage: python -m planarium.plans.jobs FOLDER OUTPUT")
    try:
        for trace in run_folder(SparkSession.builder.getOrCreate(), sys.argv[1], sys.argv[2], comparison=True):
            trace.orderBy("step").show(truncate=False)
    except FileNotFoundError as x:
        sys.exit(str(x))
