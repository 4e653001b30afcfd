"""Deliberate damage to links, by the order of ids, so that it is the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """df with n, its place (from 1) in the order of keys, without one task for all: places inside ranges, and the ranges' sizes."""
    from pyspark.sql import Window

    ranged = durable(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn("n", F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def added_edges(vertices: DataFrame, period: int = 5) -> DataFrame:
    """src, dst: of every `period` vertices in order, a link from the first to the last."""
    rows = _numbered(vertices.select("id"), "id")
    group = F.floor((F.col("n") - 1) / period)
    ends = rows.groupBy(group.alias("g")).agg(F.min("id").alias("src"), F.max("id").alias("dst"), F.count("*").alias("c"))
    return ends.where(F.col("c") == period).select("src", "dst")


def without_every(edges: DataFrame, x: int) -> DataFrame:
    """Edges without every (x + 1)-th in order."""
    return _numbered(edges, "src", "dst").where(F.pmod(F.col("n"), F.lit(x + 1)) != 0).drop("n")


def sub_graph(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """Vertices whose id is listed."""
    return vertices.join(ids.select("id"), "id", "left_semi")


def sample_components(vertices: DataFrame, n: int, key: str = "cc_id") -> DataFrame:
    """Vertices of the n components with the smallest ids: a sample, by definition."""
    return vertices.join(vertices.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def components_with_source(vertices: DataFrame, source: str, n: int, least: int = 3, key: str = "cc_id") -> DataFrame:
    """Vertices of all components that hold the source, and of the n first (by id) of at least `least` sources: a sample, by definition."""
    sizes = vertices.groupBy(key).agg(F.count_distinct("data_source").alias("_n"), F.max((F.col("data_source") == source).cast("int")).alias("_has"))
    first = sizes.where(F.col("_n") >= least).orderBy(key).limit(n).select(key)
    return vertices.join(sizes.where("_has = 1").select(key).unionByName(first).distinct(), key, "left_semi")
