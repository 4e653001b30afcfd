"""Readers and writers of graphs: JSON lines, CSV, EAV properties, JDBC, and the paths of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits, text

#: Properties that hold one or several values, and those that are long numbers.
SEVERAL = ("dataSources", "clusteredVertices", "type", "typeIntern", "compType")
VERTEX = "id BIGINT, data MAP<STRING, STRING>"
EDGE = "source BIGINT, target BIGINT, data MAP<STRING, STRING>"


def step_path(path: str, part: str, step: str | None = None, absolute: bool = False) -> str:
    """Where vertices or edges lie: input/, output/<step>/, or the path itself."""
    path = path.rstrip("/")
    if absolute:
        return f"{path}/{part}/"
    return f"{path}/output/{step}/{part}/" if step else f"{path}/input/{part}/"


def values(x: Column, kind: str = "string") -> Column:
    """An array from the text of a value or of a JSON array; null stays null."""
    listed = F.from_json(x, T.ArrayType(T.StringType()))
    return F.when(F.ltrim(x).startswith("["), listed).when(x.isNotNull(), F.array(x)).cast(f"array<{kind}>")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """id, data map<string, string> of JSON lines; arrays stay as their JSON text (see values())."""
    return spark.read.schema(VERTEX).option("allowTrailingComma", True).json(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, data."""
    return spark.read.schema(EDGE).json(path).select(F.col("source").alias("src"), F.col("target").alias("dst"), "data")


def read_graph(spark: SparkSession, path: str, step: str | None = None, absolute: bool = False) -> tuple[DataFrame, DataFrame]:
    return read_vertices(spark, step_path(path, "vertices", step, absolute)), read_edges(spark, step_path(path, "edges", step, absolute))


def typed_vertices(vertices: DataFrame) -> DataFrame:
    """Vertices as entities, with real columns for the known properties."""
    d = lambda k: F.col("data")[k]
    return vertices.select(
        "id", text.sane(d("label")).alias("label"), d("dataSource").alias("data_source"), values(d("dataSources")).alias("data_sources"),
        F.coalesce(values(d("clusteredVertices"), "long"), F.array("id")).alias("clustered"), F.coalesce(values(d("typeIntern")), values(d("type"))).alias("types"),
        d("typeDetail").alias("type_detail"), d("lat").try_cast("double").alias("lat"), d("lon").try_cast("double").alias("lon"), d("ccId").try_cast("long").alias("cc_id"),
        d("hashCc").try_cast("long").alias("hash_cc"), d("oldHashCc").try_cast("long").alias("old_hash_cc"), d("artist").alias("artist"), d("album").alias("album"),
        d("number").alias("number"), d("year").try_cast("int").alias("year"), d("length").try_cast("int").alias("length"), d("language").alias("language"), d("blockingLabel").alias("blocking_label"),
    )


def write_vertices(df: DataFrame, path: str) -> None:
    """JSON lines {"id", "data"}; data is a struct of all other columns, without nulls."""
    data = [c for c in df.columns if c != "id"]
    df.select("id", F.struct(*data).alias("data")).write.mode("overwrite").json(path)


def write_edges(df: DataFrame, path: str) -> None:
    data = [c for c in df.columns if c not in ("src", "dst")]
    rows = [F.col("src").alias("source"), F.col("dst").alias("target")]
    df.select(*rows, *([F.struct(*data).alias("data")] if data else [])).write.mode("overwrite").json(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, step: str) -> None:
    write_vertices(vertices, step_path(path, "vertices", step))
    write_edges(edges, step_path(path, "edges", step))


def write_tuples(df: DataFrame, path: str) -> None:
    """JSON lines {"t0", "t1", ...} of strings, for at most 20 columns."""
    if len(df.columns) > 20:
        raise ValueError("tuples have at most 20 fields")
    df.select(*(F.col(f"`{c}`").cast("string").alias(f"t{i}") for i, c in enumerate(df.columns))).write.mode("overwrite").json(path)


#: Columns of the music file; two of them aren't used.
MUSIC = "TID BIGINT, CID BIGINT, CTID BIGINT, SourceID INT, id STRING, number STRING, title STRING, length STRING, artist STRING, album STRING, year STRING, language STRING"


def read_music(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a music file, cleaned."""
    rows = spark.read.schema(MUSIC).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    label, artist, album = (F.col(c) for c in ("title", "artist", "album"))
    source = F.col("SourceID").cast("string")
    return rows.select(
        F.col("TID").alias("id"), F.col("CID").alias("cc_id"), source.alias("data_source"), bits.encode_one(source, bits.MUSIC_SOURCES).alias("sources_int"), F.coalesce(text.sane(label), F.lit(None)).alias("label"),
        text.sane(artist).alias("artist"), text.sane(album).alias("album"), text.sane("number").alias("number"), F.coalesce(text.song_length("length"), F.lit(0)).alias("length"),
        F.coalesce(text.year("year"), F.lit(0)).alias("year"), text.language("language").alias("language"), text.artist_title_album(artist, label, album).alias("ata"), F.array("TID").alias("clustered"),
    )


def no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "src BIGINT, dst BIGINT")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """id, url, data_source of a concept file, of the known sources only; bad lines are left out."""
    rows = spark.read.schema("id BIGINT, url STRING, data_source STRING").option("sep", ";").option("mode", "DROPMALFORMED").csv(path)
    return rows.where(F.col("data_source").isin(*bits.GEO_SOURCES))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """id, key, value, kind."""
    return spark.read.schema("id BIGINT, key STRING, value STRING, kind STRING").option("sep", ";").csv(path)


def with_properties(vertices: DataFrame, properties: DataFrame, order: str | None = None) -> DataFrame:
    """Vertices with label, lat, lon, types from EAV rows; those without a label go.

    Of several values the smallest counts, or with `order`, a column of the rows, the first: there a vertex takes nothing
    from rows behind the one that completes its first pair of lat and lon.
    """
    kinds = {"label": "string", "lat": "double", "lon": "double"}
    value = lambda k: F.when(F.col("key") == k, F.col("value").try_cast(kinds[k]))
    types_ = F.array_sort(F.collect_set(F.when(F.col("key") == "type", F.col("value")))).alias("types")
    if order is None:
        wide = properties.groupBy("id").agg(*(F.min(value(k)).alias(k) for k in kinds), types_)
    else:
        first = lambda k: F.min(F.when(value(k).isNotNull(), F.col(order)))
        ends = properties.groupBy("id").agg(first("lat").alias("_a"), first("lon").alias("_b"))
        ends = ends.select("id", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b")).alias("_end"))
        some = properties.join(ends, "id").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
        wide = some.groupBy("id").agg(*(F.min(F.when(value(k).isNotNull(), F.struct(F.col(order), value(k).alias("v"))))["v"].alias(k) for k in kinds), types_)
    return vertices.join(wide, "id").where("label IS NOT NULL")


def local_rows(df: DataFrame, most: int = 100_000) -> list:
    """The rows on the driver; raises if they are more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them to a table")
    return rows


def fan_out(vertices: DataFrame, components: DataFrame, edges: DataFrame) -> DataFrame:
    """cc_id, id, dst of every listed component (cc_id): its vertices (id, cc_id), none as null, and their links, none as null."""
    inside = vertices.select("id", "cc_id").join(components.select("cc_id").distinct(), "cc_id", "right")
    return inside.join(edges.select(F.col("src").alias("id"), "dst"), "id", "left").select("cc_id", "id", "dst")


def read_pairs(spark: SparkSession, path: str, sep: str = ";", a: str = "src", b: str = "dst") -> DataFrame:
    """Two columns of ids: links, or vertices and their components."""
    return spark.read.schema(f"{a} BIGINT, {b} BIGINT").option("sep", sep).csv(path)


def read_gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of a file of two ids of digits, s and a copy number."""
    rows = spark.read.schema("a STRING, b STRING").csv(path)
    return rows.select(F.least(text.nc_id("a"), text.nc_id("b")).alias("src"), F.greatest(text.nc_id("a"), text.nc_id("b")).alias("dst"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").try_cast("long").alias("id")).where("id IS NOT NULL")


def read_jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A query of a database; with a numeric key and its bounds, in so many parallel parts."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key:
        split = {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
        return reader.option("dbtable", f"({query}) q").options(**split).load()
    return reader.option("query", query).load()


def read_graph_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph heads, vertices, edges of a graph in three JSON files: string ids, data, meta.label (and source, target)."""
    path = path.rstrip("/")
    common = "id STRING, data MAP<STRING, STRING>, meta STRUCT<label: STRING, graphs: ARRAY<STRING>>"
    heads, vertices = (spark.read.schema(common).json(f"{path}/{n}.json") for n in ("graphHeads", "vertices"))
    return heads, vertices, spark.read.schema(common + ", source STRING, target STRING").json(f"{path}/edges.json")


#: Names of properties in graph files, by domain: those of entities here, and the ones there.
FILE_NAMES = {
    "music": {"label": "title", "artist": "artist", "album": "album", "number": "number", "language": "language", "year": "year", "length": "length", "data_source": "srcId", "key": "id", "cc_id": "cid"},
    "nc": {"label": "name", "artist": "surname", "album": "suburb", "number": "postcod", "data_source": "type", "key": "recId"},
    "geo": {"label": "label", "lat": "lat", "lon": "lon", "data_source": "ontology", "key": "id"},
}


def from_graph_files(vertices: DataFrame, edges: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """Entities and links with long ids, from properties renamed by domain; links whose ends are missing go."""
    names = FILE_NAMES[domain]
    key = F.col("data")[names["key"]]
    number = text.nc_id(key) if domain == "nc" else key.try_cast("long")
    rows = vertices.select(F.col("id").alias("_graph_id"), F.coalesce(number, F.xxhash64("id")).alias("id"), *(F.col("data")[v].alias(k) for k, v in names.items() if k != "key"))
    ids = rows.select("_graph_id", "id")
    out = edges.select("source", "target").join(ids.select(F.col("_graph_id").alias("source"), F.col("id").alias("src")), "source", "left").join(ids.select(F.col("_graph_id").alias("target"), F.col("id").alias("dst")), "target", "left")
    return rows.drop("_graph_id"), out.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
