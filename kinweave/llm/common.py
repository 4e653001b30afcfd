"""Shared plumbing of the text operators: Arrow maps in short batches, and what the session gives."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import Tables, durable, scratch, ship, written

__all__ = ["KEPT", "Tables", "arrow_rows", "as_bytes", "durable", "forget", "lean", "release", "scratch", "small_batches", "spread", "written"]

#: Rows in an Arrow batch sent to Python. Texts may be long, so batches are kept short; nothing is cut.
BATCH_ROWS = 1000


#: What empties the memories that operators keep in a worker from task to task.
KEPT: list[Callable[[], object]] = []


def release() -> None:
    """Give the system what this worker has freed; glibc and Arrow's pool hold it else for as long as the worker is used again."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def forget() -> None:
    """Empty what operators keep in this worker. Tasks call it by name, so that it is the worker's own that goes."""
    for empty in KEPT:
        empty()
    release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for operators that keep nothing: tasks begin without what other operators left in their worker, and leave nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from run(batches)
        finally:
            release()

    return task


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a worker's memory doesn't depend on Spark's 10,000-row default; ship the package."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is read from fewer pieces than there are cores: one small file would keep one busy.

    Large inputs come in more pieces and are left as they are, and so is what comes out of an exchange.
    """
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.toString() or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def arrow_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow over single batches; fn may return None for no rows."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
