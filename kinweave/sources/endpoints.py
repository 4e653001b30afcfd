"""Properties from services and databases: what to ask for, how to read answers, and tables of properties that change.

A service is asked by a function that the caller gives (address -> text of the answer, None if there is none), so that time
limits, keys and proxies are the caller's; it runs in Arrow batches, and `parallel` bounds how many ask at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_rows

#: Names of the properties that are kept, by the names that services have for them.
PROPERTY_NAMES = {
    "http://www.w3.org/2000/01/rdf-schema#label": "label", "http://www.w3.org/2003/01/geo/wgs84_pos#lat": "lat", "http://www.w3.org/2003/01/geo/wgs84_pos#long": "lon",
    "http://www.w3.org/2003/01/geo/wgs84_pos#alt": "ele", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type": "type",
}


def sparql_query(uri: Column) -> Column:
    """The query for all properties of one resource. A name that isn't an address raises in the task."""
    safe = F.when(uri.rlike(r'^[a-zA-Z][a-zA-Z0-9+.-]*:[^\s<>"{}|\\^`]*$'), uri).otherwise(F.raise_error(F.concat(F.lit("no address: "), uri)))
    return F.concat(F.lit("SELECT ?p ?o WHERE { <"), safe, F.lit("> ?p ?o }"))


def answers(df: DataFrame, ask: Callable[[str], str | None], column: str = "request", key: str = "id", parallel: int = 8) -> DataFrame:
    """id, answer of the rows whose request is answered; each different request is asked once."""
    asked = df.select(column).distinct().repartition(parallel)

    def one(row: dict) -> list[tuple]:
        got = ask(row[column])
        return [] if got is None else [(row[column], got)]

    got = map_rows(asked, one, "_request string, answer string")
    return df.join(got, F.col(column) == F.col("_request")).select(key, "answer")


_TERM = "STRUCT<type: STRING, value: STRING>"
_SPARQL = f"STRUCT<results: STRUCT<bindings: ARRAY<STRUCT<p: {_TERM}, o: {_TERM}>>>>"


def _kept(rows: DataFrame) -> DataFrame:
    """id, key, value of the properties that are kept, under their short names."""
    table = F.create_map(*(F.lit(x) for pair in PROPERTY_NAMES.items() for x in pair))
    return rows.select("id", F.element_at(table, F.col("name")).alias("key"), "value").where("key IS NOT NULL AND value IS NOT NULL").distinct()


def from_sparql(df: DataFrame) -> DataFrame:
    """id, key, value of answers (id, answer) in the JSON form of SPARQL results; what can't be read gives nothing."""
    found = df.select("id", F.explode(F.from_json("answer", _SPARQL)["results"]["bindings"]).alias("b"))
    return _kept(found.select("id", F.col("b.p.value").alias("name"), F.col("b.o.value").alias("value")))


def from_triples(df: DataFrame) -> DataFrame:
    """id, key, value of answers (id, answer) of lines of triples: <subject> <property> <value> or "value" and a full stop."""
    lines = df.select("id", F.explode(F.split("answer", r"\r?\n")).alias("line"))
    pattern = r'^\s*<[^>]*>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)")'
    part = lambda i: F.regexp_extract("line", pattern, i)
    value = F.when(part(2) != "", part(2)).otherwise(F.regexp_replace(part(3), r"\\(.)", "$1"))
    return _kept(lines.select("id", part(1).alias("name"), value.alias("value")))


def from_topics(df: DataFrame) -> DataFrame:
    """id, key, value of answers (id, answer) in JSON of the form {"property": {name: {"values": [{"value": ...}]}}}."""
    shape = "STRUCT<property: MAP<STRING, STRUCT<values: ARRAY<STRUCT<value: STRING>>>>>"
    found = df.select("id", F.explode(F.from_json("answer", shape)["property"]).alias("name", "v"))
    return _kept(found.select("id", "name", F.explode("v.values.value").alias("value")))


def feature_code(xml: Column) -> Column:
    """Class and code of a place in an XML answer of a gazetteer, as P.PPL; null if either is missing."""
    parts = [F.xpath_string(xml, F.lit(f"//{name}/text()")) for name in ("fcl", "fcode")]
    return F.when((parts[0] != "") & (parts[1] != ""), F.concat_ws(".", *parts))


# --- tables of properties (id, key, value)


def upserted(properties: DataFrame, changes: DataFrame) -> DataFrame:
    """Properties with changes: a property of the same id and key is replaced, others are added."""
    return properties.join(changes.select("id", "key"), ["id", "key"], "left_anti").unionByName(changes.select(*properties.columns))


def deleted(properties: DataFrame, gone: DataFrame) -> DataFrame:
    """Properties without those of the listed ids and keys; without a key, none of the id's stays."""
    keys = gone if "key" in gone.columns else gone.select("id")
    return properties.join(keys, [c for c in ("id", "key") if c in keys.columns], "left_anti")


def ids_without(ids: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """Ids that lack a property."""
    return ids.select("id").join(properties.where(F.col("key") == key).select("id"), "id", "left_anti")


def component_ids(rows: DataFrame, key: str = "cc_id") -> DataFrame:
    """The ids of all components, each once."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows into a table of a database; overwrite keeps the table's definition."""
    df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).option("truncate", "true").options(**options).save()


#: Rows of a log of what went wrong.
LOG = T.StructType([T.StructField("id", T.LongType()), T.StructField("request", T.StringType()), T.StructField("error", T.StringType())])


def log_entries(asked: DataFrame, got: DataFrame, column: str = "request") -> DataFrame:
    """id, request, error of the rows that have no answer."""
    missing = asked.join(got.select("id").distinct(), "id", "left_anti")
    return missing.select(F.col("id").cast("long").alias("id"), F.col(column).alias("request"), F.lit("no answer").alias("error"))
