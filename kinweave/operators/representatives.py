"""One row for a cluster: majority values, the preferred place, and what its members add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.bits import PLACE_ORDER


def majority(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """key, out: the most frequent value of a key; ties go to the longer, then the smaller string."""
    counts = df.select(key, value.alias("v")).where("v IS NOT NULL").groupBy(key, "v").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.char_length("v")).alias("l"), "v"))
    return counts.groupBy(key).agg(best["v"].alias(out))


def _common(df: DataFrame, key: str) -> DataFrame:
    """key, id, clustered, data_sources, sources_int."""
    return df.groupBy(key).agg(
        F.min("id").alias("id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("clustered")))).alias("clustered"),
        F.array_sort(F.collect_set("data_source")).alias("data_sources"),
        F.bit_or("sources_int").alias("sources_int"),
    )


def _with_majorities(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    out = _common(df, key)
    for name, value in values.items():
        out = out.join(majority(df, key, value, name), key, "left")
    return out


def music(df: DataFrame, key: str = "hash_cc") -> DataFrame:
    """Majority of the simplified artist, title and album as label."""
    return _with_majorities(df, key, {"label": text.simplify("ata")})


def nc(df: DataFrame, key: str = "hash_cc") -> DataFrame:
    """Majorities of label, artist, album and number, each on its own."""
    return _with_majorities(df, key, {c: text.simplify(text.sane(c)) for c in ("label", "artist", "album", "number")})


def places(df: DataFrame, key: str = "hash_cc") -> DataFrame:
    """Majority label, all types, and the coordinates of the preferred source (then of the first source by name)."""
    out = _with_majorities(df, key, {"label": text.simplify(text.sane("label"))})
    rank = F.coalesce(*(F.when(F.col("data_source") == s, F.lit(i)) for i, s in enumerate(PLACE_ORDER)), F.lit(len(PLACE_ORDER)))
    good = df.where(geo.valid(F.col("lat"), F.col("lon"))).groupBy(key).agg(F.min(F.struct(rank.alias("r"), "data_source", "id", "lat", "lon")).alias("p"))
    kinds = df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"))
    return out.join(good.select(key, "p.lat", "p.lon"), key, "left").join(kinds, key, "left")


REPRESENTATIVES = {"music": music, "nc": nc, "geo": places}


def represent(df: DataFrame, domain: str, key: str = "hash_cc") -> DataFrame:
    """Representatives of the clusters of a domain."""
    return REPRESENTATIVES[domain](df, key)


def as_clusters(df: DataFrame, domain: str, length: int = 4) -> DataFrame:
    """Single rows as clusters of themselves, with a blocking key: arrays of sources and members where they are missing."""
    out = df
    if "clustered" not in df.columns:
        out = out.withColumn("clustered", F.array("id"))
    if "data_sources" not in df.columns:
        out = out.withColumn("data_sources", F.array("data_source"))
    if domain == "music" and "ata" not in df.columns:
        out = out.withColumn("ata", text.artist_title_album("artist", "label", "album"))
    return out.withColumn("blocking_label", text.block_key(domain, length))
