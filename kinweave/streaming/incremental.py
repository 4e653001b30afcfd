"""Incremental clustering of a stream: each micro-batch of new rows joins the clusters kept in a table.

State is a table of numbered versions. A batch reads the version before its own and writes its own, so a batch that is run
again after a failure finds the same state and overwrites the same version: results are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..plans import workflows


def version_path(path: str, n: int) -> str:
    return f"{path.rstrip('/')}/version={n}"


def start(rows: DataFrame, path: str, config: workflows.Config, bit: int, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Add the rows of one source, as they arrive, to the clusters at version 0 of `path`."""

    def batch(new: DataFrame, epoch: int) -> None:
        spark = new.sparkSession
        clusters = spark.read.parquet(version_path(path, epoch))
        workflows.add_source(clusters, new, config, bit).write.mode("overwrite").parquet(version_path(path, epoch + 1))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
