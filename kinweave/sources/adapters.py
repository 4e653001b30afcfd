"""Tables of the star schema as entities and links, in Spark and (for checks) as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, text, types

#: Entities of `part`: five music sources.
PART_SQL = """(SELECT p_partkey AS id, p_name AS label, p_brand AS artist, p_type AS album, CAST(p_size AS VARCHAR) AS number, p_size AS length,
  1950 + p_size AS year, CAST(1 + p_partkey % 5 AS VARCHAR) AS data_source, CAST(1 << CAST(p_partkey % 5 AS INTEGER) AS BIGINT) AS sources_int FROM part)"""
#: Entities of `supplier`: places of five sources with made coordinates and types.
GEO_SQL = """(SELECT s_suppkey AS id, s_name AS label, (s_suppkey * 7919 % 18000) / 100.0::DOUBLE - 90 AS lat, (s_suppkey * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon,
  ['http://data.nytimes.com/', 'http://dbpedia.org/', 'http://linkedgeodata.org/', 'http://rdf.freebase.com/', 'http://sws.geonames.org/'][s_nationkey % 5 + 1] AS data_source,
  CAST(1 << CAST(s_nationkey % 5 AS INTEGER) AS BIGINT) AS sources_int,
  [['School'], ['Island'], ['Settlement'], ['Country'], ['BodyOfWater'], ['no_type']][s_nationkey % 6 + 1] AS types, s_nationkey AS nation FROM supplier)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = (F.col("p_partkey") % 5 + 1).cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"),
        F.col("p_size").cast("string").alias("number"), F.col("p_size").alias("length"), (F.col("p_size") + 1950).alias("year"), source.alias("data_source"),
        bits.encode_one(source, bits.MUSIC_SOURCES).alias("sources_int"), text.artist_title_album("p_brand", "p_name", "p_type").alias("ata"),
        F.array("p_partkey").alias("clustered"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("School", "Island", "Settlement", "Country", "BodyOfWater", "no_type")
    nation = F.col("s_nationkey")
    source = F.get(F.array(*(F.lit(s) for s in bits.GEO_SOURCES)), nation % 5)
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), ((F.col("s_suppkey") * 7919 % 18000) / 100 - 90).alias("lat"),
        ((F.col("s_suppkey") * 104729 % 36000) / 100 - 180).alias("lon"), source.alias("data_source"), bits.encode_one(source, bits.GEO_SOURCES).alias("sources_int"),
        F.array(F.get(F.array(*(F.lit(k) for k in kinds)), nation % 6)).alias("types"), nation.alias("nation"), F.array("s_suppkey").alias("clustered"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("label"), F.col("lang").alias("language"), F.col("source").alias("data_source"))


#: Links of `part`: each part to the next one (by id) of the same name and brand, so links grow with the rows.
PART_EDGES_SQL = """(SELECT src, dst FROM (SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS dst FROM part) WHERE dst IS NOT NULL)"""
#: Links of `supplier`: a ring over the ids, by steps of 1 and 3.
GEO_EDGES_SQL = """(SELECT s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 3 FROM supplier WHERE s_suppkey % 4 = 0)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    after = F.lead("id").over(Window.partitionBy("label", "artist").orderBy("id"))
    return parts(spark, sf_dir).select(F.col("id").alias("src"), after.alias("dst")).where("dst IS NOT NULL")


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    return ids.select("src", (F.col("src") + 1).alias("dst")).unionByName(ids.where("src % 4 = 0").select("src", (F.col("src") + 3).alias("dst")))
