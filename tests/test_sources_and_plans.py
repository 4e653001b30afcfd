"""Readers, writers, workflows, streams, and every query against its SQL."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.functions import bits
from kinweave.plans import registry, workflows
from kinweave.sources import adapters, graphs
from kinweave.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_json_graph(spark, tmp_path, rows):
    (tmp_path / "input/vertices").mkdir(parents=True)
    (tmp_path / "input/edges").mkdir()
    lines = [{"id": 1, "data": {"label": "a", "type": "x", "lat": 1.5, "clusteredVertices": [1, 2]}}, {"data": {"label": "no_value", "type": ["x", "y"]}, "id": 2}]
    (tmp_path / "input/vertices/vertices.json").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "input/edges/edges.json").write_text('{"source": 1, "target": 2}\n')
    v, e = graphs.read_graph(spark, str(tmp_path))
    got = {r["id"]: r for r in graphs.typed_vertices(v).collect()}
    assert got[1]["types"] == ["x"] and got[2]["types"] == ["x", "y"] and got[1]["clustered"] == [1, 2] and got[2]["clustered"] == [2]
    assert got[1]["lat"] == 1.5 and got[2]["label"] is None
    assert rows(e, "src", "dst") == [(1, 2)]
    graphs.write_graph(v.select("id", F.col("data")["label"].alias("label")), e.select("src", "dst"), str(tmp_path), "one")
    again, edges = graphs.read_graph(spark, str(tmp_path), "one")
    assert rows(graphs.typed_vertices(again), "id", "label") == [(1, "a"), (2, None)] and rows(edges, "src", "dst") == [(1, 2)]


def test_paths():
    assert graphs.step_path("p", "edges") == "p/input/edges/"
    assert graphs.step_path("p/", "edges", "s") == "p/output/s/edges/"
    assert graphs.step_path("p", "edges", absolute=True) == "p/edges/"


def test_music_file(spark, tmp_path):
    head = "TID,CID,CTID,SourceID,id,number,title,length,artist,album,year,language"
    (tmp_path / "m.csv").write_text(f'{head}\n1,7,1,2,x,3,"Foo, bar",2m 27sec,The X,--,\'05,English\n2,7,2,3,y,--,no_value,unk.,--,B,,German, French\n')
    got = {r["id"]: r for r in graphs.read_music(spark, str(tmp_path / "m.csv")).collect()}
    assert (got[1]["label"], got[1]["length"], got[1]["year"], got[1]["language"], got[1]["ata"], got[1]["sources_int"]) == ("Foo, bar", 147, 2005, "english", "the x foo bar", 2)
    assert (got[2]["label"], got[2]["length"], got[2]["number"], got[2]["artist"]) == (None, 0, None, None)


def test_other_files(spark, tmp_path, rows):
    (tmp_path / "c.csv").write_text("1;http://dbpedia.org/x;http://dbpedia.org/\n2;u;elsewhere\nbad\n")
    (tmp_path / "p.csv").write_text("1;label;Foo;string\n1;lat;1.5;double\n1;type;lake;string\n2;lat;3;double\n")
    (tmp_path / "e.csv").write_text("1;2\n")
    (tmp_path / "ids.txt").write_text("5\n\n7\n")
    (tmp_path / "g.csv").write_text("05802084s2,05802084s1\n")
    concepts = graphs.read_concepts(spark, str(tmp_path / "c.csv"))
    assert rows(graphs.with_properties(concepts, graphs.read_properties(spark, str(tmp_path / "p.csv"))), "id", "label", "lat") == [(1, "Foo", 1.5)]
    assert rows(graphs.read_pairs(spark, str(tmp_path / "e.csv"))) == [(1, 2)]
    assert rows(graphs.read_ids(spark, str(tmp_path / "ids.txt"))) == [(5,), (7,)]
    assert rows(graphs.read_gold_pairs(spark, str(tmp_path / "g.csv"))) == [(105802084, 205802084)]
    graphs.write_tuples(spark.createDataFrame([(1, "a")], "x long, y string"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).head().asDict() == {"t0": "1", "t1": "a"}


def test_graph_files(spark, tmp_path, rows):
    for name, lines in {"graphHeads": [{"id": "g", "data": {}, "meta": {"label": "G"}}], "vertices": [{"id": "aa", "data": {"id": "4", "title": "T", "srcId": "1"}, "meta": {}}, {"id": "bb", "data": {"id": "5", "title": "U", "srcId": "2"}, "meta": {}}], "edges": [{"id": "e", "source": "aa", "target": "bb", "data": {}, "meta": {}}, {"id": "f", "source": "aa", "target": "zz", "data": {}, "meta": {}}]}.items():
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, lines)))
    _, v, e = graphs.read_graph_files(spark, str(tmp_path))
    rows_, links_ = graphs.from_graph_files(v, e, "music")
    assert rows(rows_, "id", "label", "data_source") == [(4, "T", "1"), (5, "U", "2")] and rows(links_) == [(4, 5)]


def small(spark, *more):
    schema = "id long, label string, artist string, album string, number string, year int, length int, data_source string"
    df = spark.createDataFrame(list(more), schema)
    return df.withColumn("sources_int", bits.encode_one(F.col("data_source"), bits.MUSIC_SOURCES)).withColumn("ata", F.lower(F.concat_ws(" ", "artist", "label", "album"))).withColumn("clustered", F.array("id")).withColumn("data_sources", F.array("data_source"))


ROWS = [(1, "hello world", "abba", "one", "1", 2000, 200, "1"), (2, "hello world", "abba", "one", "1", 2000, 201, "2"), (3, "hello worle", "abba", "one", "1", 2000, 200, "3"), (4, "goodbye", "queen", "two", "2", 1990, 100, "1"), (5, "hello world", "abba", "one", "1", 2000, 200, "2")]


def test_initial_clustering(spark, rows):
    got = rows(workflows.initial(small(spark, *ROWS), workflows.Config()), "id", "clustered")
    members = sorted(tuple(c) for _, c in got)
    assert sorted(x for c in members for x in c) == [1, 2, 3, 4, 5] and (4,) in members
    # one row a source at most: 2 and 5 are never together
    assert not any({2, 5} <= set(c) for c in members) and any(len(c) == 3 for c in members)


@pytest.mark.parametrize("match", ["max_both", "hungarian"])
def test_source_addition(spark, rows, match):
    df = small(spark, *ROWS)
    got = workflows.add_source(df.where("data_source <> '3'"), df.where("data_source = '3'"), workflows.Config(match=match), 4)
    assert [c for _, c in rows(got, "id", "clustered")] == [[1, 3], [2], [4], [5]]


def test_stream(spark, tmp_path, rows):
    df = small(spark, *ROWS)
    names = ["id", "clustered", "data_sources", "sources_int", "label", "artist", "album", "number", "year", "length", "ata"]
    state = str(tmp_path / "state")
    df.where("data_source = '1'").select(*names).write.parquet(incremental.version_path(state, 0))
    df.where("data_source = '2' AND id = 2").select(*names).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.select(*names).schema).parquet(str(tmp_path / "in"))
    incremental.start(stream, state, workflows.Config(), 2, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(incremental.version_path(state, 1)), "id", "clustered") == [(1, [1, 2]), (4, [4])]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    return repr(round(float(x), 6) + 0.0) if hasattr(x, "__float__") and not isinstance(x, str) else str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    flat = lambda df: sorted(tuple(map(normal, r)) for r in df[columns].itertuples(index=False))
    assert flat(got) == flat(want)


@pytest.mark.parametrize("name", ["merge_execution_music", "merge_execution_nc", "merge_execution_geo", "incremental_initial", "incremental_source", "holistic_places"])
def test_clusters_are_a_partition(spark, name):
    got = registry.QUERIES[name](spark, SF).collect()
    members = [int(x) for r in got for x in r["clustered"].split(",")]
    assert len(members) == len(set(members))
    assert all(r["sources_int"].bit_count() == len(r["clustered"].split(",")) for r in got)
    geo = name in ("merge_execution_geo", "holistic_places")
    every = {r["id"] for r in (adapters.places if geo else adapters.parts)(spark, SF).select("id").collect()}
    assert set(members) == every or name == "incremental_initial" and set(members) < every


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["incremental_initial", "incremental_vertex"])
def test_clusters_hold_all_sources(spark, name):
    members = [int(x) for r in registry.QUERIES[name](spark, SF).collect() for x in r["clustered"].split(",")]
    assert sorted(members) == sorted(r["id"] for r in adapters.parts(spark, SF).select("id").collect())


@pytest.mark.parametrize("domain", ["music", "nc"])
def test_merges_block_untouched_labels(spark, monkeypatch, domain):
    calls = []
    monkeypatch.setattr(registry.merging, "merge_clusters", lambda rows, *args: calls.append((rows, args)) or rows)
    registry._merge_parts(spark, SF, domain)
    (rows, args), parts = calls[0], adapters.parts(spark, SF)
    assert args == (domain, 0.9, 5)  # the key's default length
    assert rows.select("id", "label", "artist").exceptAll(parts.select("id", "label", "artist")).count() == 0


@pytest.mark.parametrize("name", ["incremental_initial", "incremental_vertex", "incremental_source"])
def test_workflows_block_untouched_labels(spark, monkeypatch, name):
    """blocks are those of the key's default length of untouched labels, so rows of other names and brands meet."""
    calls = []
    for step in ("initial", "add_rows", "add_source"):
        monkeypatch.setattr(registry.workflows, step, lambda *args: calls.append(args) or args[0])
    registry.QUERIES[name](spark, SF)
    rows, config, parts = calls[0][0], next(a for a in calls[0] if isinstance(a, registry.workflows.Config)), adapters.parts(spark, SF)
    assert config.block_length == 4
    assert rows.select("id", "label", "artist").exceptAll(parts.select("id", "label", "artist")).count() == 0
