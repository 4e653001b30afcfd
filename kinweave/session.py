"""What a session needs before its workers run this package's Python code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_kinweave_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="kinweave-"), "kinweave.zip")  # the driver serves it as long as it runs
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    z.write(file, os.path.join("kinweave", os.path.relpath(file, here)))
    context.addPyFile(path)
    context._kinweave_shipped = True


def _folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the cluster's spark.checkpoint.dir; it goes when the application ends.

    Where that is unset, a local master gets a temporary folder (tests); any other raises, as executors share no local folder.
    """
    context = spark.sparkContext
    if (known := getattr(context, "_kinweave_folder", None)) is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            made = context._jsc.sc().getCheckpointDir()
            if made.isEmpty():
                if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
                context.setCheckpointDir(tempfile.mkdtemp(prefix="kinweave-"))
                made = context._jsc.sc().getCheckpointDir()
            root = made.get()
        known = context._kinweave_folder = f"{root.rstrip('/')}/kinweave/{context.applicationId}"
        place, files = _place(spark, known)
        files.mkdirs(place)
        files.deleteOnExit(place)
    return known


def _place(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder for an intermediate table."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet to this path and read it again. The shuffle files that the writing made go with it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs nothing before it."""
    return written(df, scratch(df.sparkSession))


class Tables:
    """Intermediate tables of one computation: written like durable(), and removed when the block ends.

    What the block gives on must be durable itself, or be read to its end inside.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.append(scratch(self.spark))
        return written(df, self.paths[-1])

    def last(self) -> str:
        """The path of the table written last, for drop()."""
        return self.paths[-1]

    def drop(self, *paths: str) -> None:
        """Remove these tables now."""
        for path in paths:
            place, files = _place(self.spark, path)
            files.delete(place, True)
        self.paths = [p for p in self.paths if p not in paths]


class Appended:
    """One table that rounds add rows to, in place of a union that grows by a branch a round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.some = spark, scratch(spark), False

    def add(self, df: DataFrame) -> DataFrame:
        """Write these rows down, add them to the table and give them back."""
        df = durable(df)
        df.write.mode("append").parquet(self.path)
        self.some = True
        return df

    def all(self, schema) -> DataFrame:
        """All rows that were added."""
        return self.spark.read.schema(schema).parquet(self.path) if self.some else self.spark.createDataFrame([], schema)


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """fn over rows as dictionaries, in Arrow batches; gives tuples of the schema's columns."""
    ship(df.sparkSession)
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                out += fn(row)
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return df.mapInArrow(run, schema)
