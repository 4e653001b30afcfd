"""Division of components: by overlapping types, by the best typed neighbour, and by similarity to the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity, text, types
from .components import stars


def by_types(vertices: DataFrame, reference_compat: bool = False) -> DataFrame:
    """Vertices (id, cc_id, types, ...) with group_id, the smallest id that shares types with them, directly or through
    others, in their component, and its hash hash_cc. Untyped vertices are alone; with reference_compat a component is one
    group whatever its types.
    """
    if reference_compat:
        return vertices.withColumn("group_id", F.col("cc_id")).withColumn("hash_cc", text.md5_little(F.col("cc_id").cast("string")))
    kinds = vertices.where(similarity.typed(F.col("types"))).select("id", "cc_id", F.explode(types.shade(F.col("types"))).alias("kind"))
    hubs = kinds.groupBy("cc_id", "kind").agg(F.min("id").alias("hub"))
    found = stars(kinds.join(hubs, ["cc_id", "kind"]).select(F.col("id").alias("u"), F.col("hub").alias("v")))
    out = vertices.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("group_id", F.coalesce("component", "id")).drop("component")
    return out.withColumn("hash_cc", text.md5_little(F.concat_ws("-", F.col("cc_id").cast("string"), F.col("group_id").cast("string"))))


def to_typed_neighbour(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Untyped vertices take the hash_cc of their best typed neighbour (highest agg_sim, then smallest hash_cc).

    One without a typed neighbour takes the larger of its own and its neighbours' hash_cc.
    """
    narrow = vertices.select("id", "hash_cc", similarity.typed(F.col("types")).alias("typed"))
    row = F.struct("id", "hash_cc", "typed")
    ends = edges.select("src", "dst", "agg_sim").join(narrow.select(F.col("id").alias("src"), row.alias("s")), "src").join(narrow.select(F.col("id").alias("dst"), row.alias("t")), "dst")
    both = ends.select(F.col("s").alias("v"), F.col("t").alias("n"), "agg_sim").unionByName(ends.select(F.col("t").alias("v"), F.col("s").alias("n"), "agg_sim"))
    near = both.where("NOT v.typed").groupBy(F.col("v.id").alias("id")).agg(
        F.min(F.when(F.col("n.typed"), F.struct((-F.col("agg_sim")).alias("o"), F.col("n.hash_cc").alias("hash_cc"))))["hash_cc"].alias("best"),
        F.max("n.hash_cc").alias("largest"),
    )
    out = vertices.join(near, "id", "left")
    return out.withColumn("hash_cc", F.coalesce("best", F.greatest("hash_cc", "largest"), "hash_cc")).drop("best", "largest")


def sim_sort(vertices: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Vertices (id, hash_cc, ...) of which those too unlike their group leave it: closed form of the iteration.

    A vertex's similarity is the mean of its edges'. It leaves if that is under `least` and no neighbour has a lower one;
    it then has old_hash_cc and a hash of its own, and status false. Vertices without edges stay.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("n"), "agg_sim").unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("n"), "agg_sim"))
    own = both.groupBy("id").agg(F.round(F.avg("agg_sim"), 6).alias("m"))
    lowest = both.join(own.select(F.col("id").alias("n"), F.col("m").alias("nm")), "n").groupBy("id").agg(F.min("nm").alias("nm"))
    judged = own.join(lowest, "id").select("id", ((F.col("m") < least) & (F.col("nm") >= F.col("m"))).alias("leaves"), F.col("m").alias("vertex_sim"))
    out = vertices.join(judged, "id", "left").withColumn("leaves", F.coalesce("leaves", F.lit(False)))
    return out.select(
        *(c for c in vertices.columns if c not in ("hash_cc", "old_hash_cc", "status")),
        F.when(F.col("leaves"), text.md5_little(F.concat(F.col("id").cast("string"), F.lit("false")))).otherwise(F.col("hash_cc")).alias("hash_cc"),
        F.when(F.col("leaves"), F.col("hash_cc")).alias("old_hash_cc"), (~F.col("leaves")).alias("status"), "vertex_sim",
    )


def best_of(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
