"""Filters of rows and pairs, and the order of a pair's ends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits


def of_source(df: DataFrame, source: str) -> DataFrame:
    """Rows of a source; clusters that hold it."""
    return of_sources(df, [source])


def of_sources(df: DataFrame, sources: Iterable[str]) -> DataFrame:
    """Rows of any of the sources: by data_source, or by data_sources where that is missing."""
    names = list(sources)
    one = F.col("data_source").isin(names) if "data_source" in df.columns else F.lit(None).cast("boolean")
    several = F.arrays_overlap("data_sources", F.array(*map(F.lit, names))) if "data_sources" in df.columns else F.lit(False)
    return df.where(F.coalesce(one, several, F.lit(False)))


def of_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select("id"), "id", "left_semi")


def of_size(df: DataFrame, n: int) -> DataFrame:
    """Clusters of n members."""
    return df.where(F.size("clustered") == n)


def at_least(df: DataFrame, threshold: float, sim: str = "sim") -> DataFrame:
    return df.where(F.col(sim) >= threshold)


def with_room(df: DataFrame, most: int) -> DataFrame:
    """Clusters of fewer than `most` sources."""
    return df.where(bits.count(F.col("sources_int")) < most)


def active(df: DataFrame) -> DataFrame:
    """Rows that aren't marked as absorbed; a missing mark counts as active."""
    return df.where(F.coalesce(F.col("status"), F.lit(True)))


def as_entity(row: Column, status: Column) -> Column:
    """A cluster's struct, null where it is marked as absorbed."""
    return F.when(F.coalesce(status, F.lit(True)), row)


def split_off(df: DataFrame) -> DataFrame:
    """Rows that left a group."""
    return df.where("old_hash_cc IS NOT NULL")


def refined(pairs: DataFrame, some: bool = True) -> DataFrame:
    """Pairs of which an end has a refine_id; without `some`, those of which none has."""
    there = F.col("s.refine_id").isNotNull() | F.col("t.refine_id").isNotNull()
    return pairs.where(there if some else ~there)


def of_equal_type(edges: DataFrame) -> DataFrame:
    return edges.where("sim_type = 1")


def _swapped(pairs: DataFrame, swap: Column) -> DataFrame:
    first = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    return pairs.select(first("src", "dst"), first("dst", "src"), first("s", "t"), first("t", "s"), *(c for c in pairs.columns if c not in ("src", "dst", "s", "t")))


def smaller_first(pairs: DataFrame) -> DataFrame:
    """Pairs (src, dst, s, t) with the smaller id as src."""
    return _swapped(pairs, F.col("src") > F.col("dst"))


def new_source_last(pairs: DataFrame, bit: int) -> DataFrame:
    """Pairs with the end that holds the new source as dst."""
    return _swapped(pairs, (F.col("s.sources_int").bitwiseAND(bit) != 0) & (F.col("t.sources_int").bitwiseAND(bit) == 0))


def ends(pairs: DataFrame) -> DataFrame:
    """Both ends of all pairs as rows, each id once."""
    return pairs.select(F.explode(F.array("s", "t")).alias("v")).select("v.*").dropDuplicates(["id"])


def transitions(pairs: DataFrame) -> DataFrame:
    """id, to: either end of a merged pair, and the id of the new cluster."""
    return pairs.select(F.explode(F.array("src", "dst")).alias("id"), F.least("src", "dst").alias("to"))


def id_types(df: DataFrame) -> DataFrame:
    """id, type rows."""
    return df.select("id", F.explode("types").alias("type"))


def sources(df: DataFrame) -> DataFrame:
    """The distinct sources of clusters."""
    return df.select(F.explode("data_sources").alias("data_source")).distinct()


def without(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of the left side without a partner."""
    return left.join(right, key, "left_anti")
