"""Tables that several jobs share, and settings that all corpus operators need."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from planarium.operators.graph import stars
from planarium.sources.store import dropped, new_path, written

__all__ = ["bucketed", "components", "dropped", "new_path", "small_batches", "written"]

#: Rows (node, root) of undirected edges (a, b).
components = stars


def small_batches(df: DataFrame, rows: int = 500) -> None:
    """Hand rows to Python in small Arrow batches: whole texts come with them, and executors hold several batches.

    Plans are lazy, so the setting must outlast the call; it stays in the session, and only lowers a larger one.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As written, in buckets by `key`, so that later joins and groups by it don't move these rows.

    The catalogue's entry goes at once; the files stay in the shared folder.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", new_path(spark, name)).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved while the entry exists
    spark.sql(f"DROP TABLE {table}")
    return out
