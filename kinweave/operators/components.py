"""Connected components by alternating stars (Kiveris et al., SoCC 2014).

A large-star step links every larger neighbour of a node to the smallest node around; a small-star step does so for the
smaller ones. Edges never multiply; both steps are a combinable minimum per node and one join, so a node with many
neighbours is neither collected nor numbered in one task. Rounds are written to the shared folder, which ends lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Tables, ship

#: Nodes that a task of spanning() remembers at most; beyond, it starts anew, which costs edges and changes no component.
HELD_NODES = 1_000_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def stars(edges: DataFrame, most: int = 100) -> DataFrame:
    """node, component (its smallest node) for every node of edges (u, v) but the smallest of each component; raises if `most` rounds don't settle them."""
    with Tables(edges.sparkSession) as tables:
        edges = tables.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before = None
        for _ in range(most):
            old = tables.last()
            edges = tables.keep(_small(_large(edges)))
            tables.drop(old)
            now = edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
            if now == before:
                tables.paths.clear()  # the result stays
                return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            before = now
    raise RuntimeError(f"components have not settled in {most} rounds")


def spanning(edges: DataFrame) -> DataFrame:
    """u, v of the edges (u, v, linked) with `linked` that join two trees of their partition: the same components, with fewer edges than nodes in each task."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            kept = pa.Table.from_batches([batch]).filter(batch.column(2))
            out = []
            for u, v in zip(kept.column(0).to_pylist(), kept.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])
            if len(parent) > HELD_NODES:
                parent.clear()

    return edges.select("u", "v", "linked").mapInArrow(run, "u long, v long")


def with_components(vertices: DataFrame, edges: DataFrame, out: str = "cc_id") -> DataFrame:
    """Vertices (id, ...) with the smallest id of their component; edges (src, dst). A vertex without links is its own."""
    found = stars(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return vertices.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn(out, F.coalesce("component", "id")).drop("component")
