"""Tables that several jobs share: written once to the cluster's shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a local session makes and sets one, a cluster's is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="planarium-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A table with a row for each cell or pair, for a join by id: joined by sort and merge, never broadcast.

    Spark judges a table by its compressed files and knows nothing of repeated
    rows or of arrays made on the way, so a few MB on disk may be a GB in the driver.
    The hint passes through projections, filters and aggregates to the next join.
    """
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` made, once nothing reads them any more."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        for folder in {f.rpartition("/")[0] for f in files}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
