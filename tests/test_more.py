"""Reports, samples, block places, hash keys, readers' rules and whole programs, on small hand-made input."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave import programs
from kinweave.functions import similarity
from kinweave.operators import blocking, components, corruption, evaluation, filters, links, overlap
from kinweave.plans import workflows
from kinweave.sources import endpoints, graphs


def test_report(spark):
    clusters = spark.createDataFrame([(1, [1, 2, 3], "a", None), (4, [4], None, "x"), (5, [5, 6], "", "y")], "id long, clustered array<long>, label string, artist string")
    gold = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (5, 5), (6, 5)], "id long, class long")
    got = {r["metric"]: r["value"] for r in evaluation.report(clusters, gold, "nc", 3).collect()}
    assert (got["clusters"], got["members"], got["single"], got["complete"], got["overfull"]) == (3, 6, 1, 1, 0)
    assert (got["tp"], got["n_found"], got["n_gold"]) == (2, 4, 2) and got["with_label"] == 1 and got["with_artist"] == 2
    with pytest.raises(ValueError, match="no report"):
        evaluation.report(clusters, gold, "cars", 3)


def test_samples_of_components(spark, rows):
    v = spark.createDataFrame([(1, 1, "n"), (2, 1, "b"), (3, 3, "a"), (4, 3, "b"), (5, 3, "c"), (6, 6, "a"), (7, 7, "a"), (8, 7, "b"), (9, 7, "c")], "id long, cc_id long, data_source string")
    assert rows(corruption.components_with_source(v, "n", 1), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(corruption.components_with_source(v, "n", 9, 1), "id") == [(i,) for i in range(1, 10)]


def test_places_of_blocks(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, "abbccc"[i % 6]) for i in range(12)], "id long, block string")
    assert rows(blocking.block_offsets(df, "block")) == [("a", 2, 1, 0), ("b", 4, 6, 1), ("c", 6, 15, 7)]
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 4)
    got = {r["id"]: (r["index"], r["part"]) for r in blocking.block_index(df, "block").where("block = 'c'").collect()}
    assert got == {3: (0, 0), 4: (1, 0), 5: (2, 0), 9: (3, 0), 10: (4, 1), 11: (5, 1)}


def test_cross_pairs_are_all_pairs(spark, rows):
    left = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(11)], "id long, k string")
    right = spark.createDataFrame([(100 + i, "abc"[i % 3]) for i in range(13)], "id long, k string")
    want = sorted(((a, 100 + b) for a in range(11) for b in range(13) if "ab"[a % 2] == "abc"[b % 3]), key=repr)
    for limit in (1, 2, 1000):
        assert rows(blocking.cross_pairs(left, right, "k", None, limit), "src", "dst") == want
    assert rows(links.side_by_side(left, right, "k"), "src", "dst") == want


def test_hash_keys(spark):
    positions = blocking.random_positions(3, 4, 20, seed=1)
    assert positions == blocking.random_positions(3, 4, 20, seed=1) != blocking.random_positions(3, 4, 20, seed=2)
    assert all(len(set(p)) == 4 and max(p) < 20 for p in positions)
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 9], [4, 9])], "a array<int>, b array<int>, c array<int>")
    families = [[1, 2], [3, 9], [17, 18]]
    key = lambda c: blocking.keys_of(F.col(c), families)
    r = df.select(key("a").alias("k"), blocking.shares_key(key("a"), key("b")).alias("ab"), blocking.shares_key(key("a"), key("c")).alias("ac")).head()
    assert r["k"] == [[1, 2], [3], []] and r["ab"] and not r["ac"]


def test_trigrams_of_any_text(spark):
    from kinweave.functions import text

    texts = [None, "", "ab", "ABC", "h\u00e9llo \U0001f600!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, x string")
    got = {r["id"]: r["g"] for r in df.select("id", text.trigrams("x").alias("g")).collect()}
    assert got == {i: [t.lower()[k : k + 3] for k in range(len(t or "") - 2)] if t else [] for i, t in enumerate(texts)}


def test_overlap_in_steps(spark, rows):
    v = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, ["a", "b"]), (4, ["c", "d", "e"])], "id long, data_sources array<string>")
    p = blocking.pairs(v.withColumn("k", F.lit(1)), "k")
    assert len(rows(links.without_overlap(p, v, "initial"))) == 6
    assert rows(links.without_overlap(p, v, "source_addition"), "src", "dst") == [(1, 2), (1, 4), (3, 4)]
    assert rows(links.without_overlap(p, v.where("id < 4"), "source_addition"), "src", "dst") == [(1, 2)]


def test_kinds_of_similarity(spark):
    columns = "id long, k int, label string, artist string, album string, number string, year int, length int, ata string"
    p = blocking.pairs(spark.createDataFrame([(1, 1, "abc", "a", "b", "1", 2000, 100, "a abc b"), (2, 1, "abd", "a", "b", "2", 2001, 100, "a abd b")], columns), "k")
    for kind in ("edge", "merge", "addition"):
        sim = links.scored_pairs(p, "music", kind).head()["sim"]
        assert 0 < sim < 1
        # links between rows have a threshold of their own
        assert links.scored_pairs(p, "music", kind, least=0.99).count() == (kind == "edge")
    with pytest.raises(ValueError, match="kind"):
        links.scored_pairs(p, "music", "other")


def test_absorbed_rows_are_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, status boolean")
    got = df.select("id", filters.as_entity(F.struct("id"), F.col("status")).alias("e")).collect()
    assert {r["id"]: r["e"] is None for r in got} == {1: False, 2: True, 3: False}
    assert {r["id"] for r in filters.active(df).collect()} == {1, 3}


def test_first_place_of_properties(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    facts = [(1, "label", "A", 1), (1, "lat", "1.0", 2), (1, "type", "lake", 3), (1, "lon", "2.0", 4), (1, "lat", "9.0", 5), (1, "type", "city", 6), (2, "lat", "3.0", 1), (2, "label", "B", 2), (2, "label", "C", 3), (3, "lat", "1", 1)]
    p = spark.createDataFrame(facts, "id long, key string, value string, n int")
    got = {r["id"]: (r["label"], r["lat"], r["lon"], r["types"]) for r in graphs.with_properties(v, p, "n").collect()}
    assert got == {1: ("A", 1.0, 2.0, ["lake"]), 2: ("B", 3.0, None, [])}


def test_component_tables(spark, rows):
    v = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, cc_id long")
    e = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert rows(links.component_edges(e, v)) == [(1, 1, 2), (1, 2, 1)]
    wanted = spark.createDataFrame([(1,), (9,)], "cc_id long")
    assert rows(graphs.fan_out(v, wanted, e.limit(1))) == [(1, 1, 2), (1, 2, None), (9, None, None)]
    assert [r["id"] for r in graphs.local_rows(v.orderBy("id"))] == [1, 2, 3]
    with pytest.raises(ValueError, match="more than 2"):
        graphs.local_rows(v, 2)


HEAD = "TID,CID,CTID,SourceID,id,number,title,length,artist,album,year,language"


@pytest.fixture
def songs(tmp_path):
    lines = [HEAD]
    for i, (title, artist) in enumerate([("silver moon river", "abba"), ("quick brown fox", "queen"), ("lonely planet song", "abba")]):
        for source in (1, 2, 3):
            lines.append(f"{10 * i + source},{i},{source},{source},x,{i},{title},2:0{i},{artist},one,2001,English")
    path = tmp_path / "songs.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize(("program", "more"), [("music", []), ("music", ["--blocking", "idf"]), ("music", ["--blocking", "lsh"]), ("incremental-music", []), ("incremental-music", ["--match", "hungarian"])])
def test_music_programs(spark, songs, tmp_path, program, more):
    """Three songs, each in three sources: three clusters, by any way."""
    out = str(tmp_path / "out")
    programs.main([program, "--input", songs, "--output", out, *more])
    found = graphs.typed_vertices(graphs.read_vertices(spark, graphs.step_path(out, "vertices", program.replace("-", "_"))))
    assert sorted(sorted(r["clustered"]) for r in found.collect()) == [[1, 2, 3], [11, 12, 13], [21, 22, 23]]
    (tmp_path / "gold.csv").write_text("1,2\n2,3\n11,12\n11,13\n21,22\n21,23\n")
    programs.main(["quality", "--input", graphs.step_path(out, "vertices", program.replace("-", "_")), "--gold", str(tmp_path / "gold.csv"), "--output", str(tmp_path / "report")])
    got = {r["metric"]: r["value"] for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert got["precision"] == got["recall"] == got["f1"] == 1 and got["clusters"] == 3


def test_rare_words_program(spark, songs, tmp_path):
    out = str(tmp_path / "out")
    programs.main(["rare-words", "--input", songs, "--output", out])
    got = graphs.read_edges(spark, graphs.step_path(out, "edges", "rare_words")).select("src", "dst").collect()
    assert sorted(map(tuple, got)) == sorted((10 * i + a, 10 * i + b) for i in range(3) for a, b in ((1, 2), (1, 3), (2, 3)))


def test_graph_programs(spark, tmp_path):
    people = tmp_path / "people"
    people.mkdir()
    (people / "graphHeads.json").write_text(json.dumps({"id": "g", "data": {}, "meta": {"label": "G"}}))
    person = lambda i, s, n: {"id": f"v{i}{s}", "data": {"recId": f"{i:08d}s{s}", "name": n, "surname": "smith", "suburb": "town", "postcod": "1234", "type": f"geco{s}"}, "meta": {}}
    rows = [person(i, s, n) for i, n in ((1, "anna"), (2, "robert")) for s in (1, 2, 3)]
    (people / "vertices.json").write_text("\n".join(map(json.dumps, rows)))
    edges = [{"id": f"e{i}{s}", "source": f"v{i}1", "target": f"v{i}{s}", "data": {}, "meta": {}} for i in (1, 2) for s in (2, 3)]
    (people / "edges.json").write_text("\n".join(map(json.dumps, edges)))
    for program in ("nc", "incremental-nc"):
        out = str(tmp_path / program)
        programs.main([program, "--input", str(people), "--output", out, "--domain", "nc"])
        found = graphs.typed_vertices(graphs.read_vertices(spark, graphs.step_path(out, "vertices", program.replace("-", "_"))))
        assert sorted(len(r["clustered"]) for r in found.collect()) == [3, 3]
    places = tmp_path / "places"
    (places / "input/vertices").mkdir(parents=True)
    (places / "input/edges").mkdir()
    town = lambda i, n, lat, s: {"id": i, "data": {"label": n, "lat": lat, "lon": 13.0, "dataSource": s, "type": "http://dbpedia.org/ontology/Settlement"}}
    lines = [town(1, "Dresden", 51.0, "http://dbpedia.org/"), town(2, "Dresden", 51.01, "http://sws.geonames.org/"), town(3, "Lima", -12.0, "http://dbpedia.org/")]
    (places / "input/vertices/v.json").write_text("\n".join(map(json.dumps, lines)))
    (places / "input/edges/e.json").write_text('{"source": 1, "target": 2}\n')
    programs.main(["settlement", "--input", str(places), "--output", str(places)])
    found = graphs.typed_vertices(graphs.read_vertices(spark, graphs.step_path(str(places), "vertices", "settlement")))
    assert sorted(sorted(r["clustered"]) for r in found.collect()) == [[1, 2], [3]]
    programs.main(["links", "--input", str(places), "--output", str(places)])
    assert [tuple(r) for r in graphs.read_edges(spark, graphs.step_path(str(places), "edges", "links")).select("src", "dst").collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="known pairs"):
        programs.main(["quality", "--input", "x", "--output", "y"])


def test_closed_links(spark, rows):
    v = spark.createDataFrame([(1, "a", "x y"), (2, "b", "x y"), (3, "c", "x z"), (4, "c", "x y"), (9, "d", "q")], "id long, data_source string, ata string")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    # of 3 and 4, which share a source, the weaker loses its links
    assert rows(workflows.close_links(v, e, workflows.Config()), "src", "dst") == [(1, 2), (1, 4), (2, 4)]


def test_answers_of_services(spark, rows):
    label, lat, kind = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2003/01/geo/wgs84_pos#lat", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    df = spark.createDataFrame([(1, "http://x/a"), (2, "http://x/b"), (3, "http://x/a")], "id long, uri string")
    asked = df.select("id", endpoints.sparql_query(F.col("uri")).alias("request"))
    with pytest.raises(Exception, match="no address"):
        df.select(endpoints.sparql_query(F.lit("http://x/> ?p ?o } #"))).collect()
    body = json.dumps({"results": {"bindings": [{"p": {"type": "uri", "value": label}, "o": {"type": "literal", "value": "A"}}, {"p": {"value": "other"}, "o": {"value": "B"}}]}})

    def ask(query):
        return body if "<http://x/a>" in query else None

    got = endpoints.answers(asked, ask, parallel=2)
    assert rows(endpoints.from_sparql(got)) == [(1, "label", "A"), (3, "label", "A")]
    assert rows(endpoints.log_entries(asked, got), "id", "error") == [(2, "no answer")]
    assert endpoints.log_entries(asked, got).schema.names == endpoints.LOG.names
    triples = f'<http://x/a> <{label}> "Say \\"A\\""@en .\n<http://x/a> <{kind}> <http://t/City> .\nnonsense'
    assert rows(endpoints.from_triples(spark.createDataFrame([(1, triples)], "id long, answer string"))) == [(1, "label", 'Say "A"'), (1, "type", "http://t/City")]
    topics = json.dumps({"property": {lat: {"values": [{"value": "1.5"}, {"value": "2"}]}, "x": {"values": [{"value": "y"}]}}})
    assert rows(endpoints.from_topics(spark.createDataFrame([(1, topics), (2, "no json")], "id long, answer string"))) == [(1, "lat", "1.5"), (1, "lat", "2")]
    xml = spark.createDataFrame([(1, "<g><fcl>P</fcl><fcode>PPL</fcode></g>"), (2, "<g><fcl>P</fcl></g>")], "id long, x string")
    assert rows(xml.select("id", endpoints.feature_code(F.col("x")).alias("c"))) == [(1, "P.PPL"), (2, None)]


def test_tables_of_properties(spark, rows):
    p = spark.createDataFrame([(1, "label", "A"), (1, "lat", "1"), (2, "label", "B")], "id long, key string, value string")
    changed = endpoints.upserted(p, spark.createDataFrame([(1, "lat", "2"), (3, "label", "C")], p.schema))
    assert rows(changed) == [(1, "label", "A"), (1, "lat", "2"), (2, "label", "B"), (3, "label", "C")]
    assert rows(endpoints.deleted(p, spark.createDataFrame([(1, "lat")], "id long, key string"))) == [(1, "label", "A"), (2, "label", "B")]
    assert rows(endpoints.deleted(p, spark.createDataFrame([(1,)], "id long"))) == [(2, "label", "B")]
    assert rows(endpoints.ids_without(spark.range(1, 4), p, "lat")) == [(2,), (3,)]
    assert rows(endpoints.component_ids(spark.createDataFrame([(1, 7), (2, 7), (3, None)], "id long, cc_id long"))) == [(7,)]


def test_databases(spark, rows):
    """Derby, which comes with Spark, in memory."""
    url = "jdbc:derby:memory:kinweave;create=true"
    p = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id long, v string")
    endpoints.write_jdbc(p, url, "props", mode="overwrite")
    endpoints.write_jdbc(spark.createDataFrame([(99, "z")], p.schema), url, "props")
    got = graphs.read_jdbc(spark, url, 'SELECT * FROM props')
    assert len(rows(got)) == 21
    split = graphs.read_jdbc(spark, url, 'SELECT "id", "v" FROM props', key='"id"', bounds=(0, 100), parts=3)
    assert split.rdd.getNumPartitions() == 3 and rows(split) == rows(got)


def test_values_and_lines(spark, rows):
    from kinweave.functions import text

    v = spark.createDataFrame([(1, "a"), (2, None)], "id long, label string")
    e = spark.createDataFrame([(1, 2), (2, 9)], "src long, dst long")
    assert rows(links.with_value(e, v, "src", "label", "l")) == [(1, 2, "a"), (2, 9, None)]
    assert rows(v.select(text.described("id", "label").alias("x"))) == [("id=1, label=a",), ("id=2",)]
    assert rows(blocking.term_counts(spark.createDataFrame([(1, "Cat the cat x1")], "id long, label string"))) == [(1, "cat", 2)]


def test_add_source_compares_rows_that_look_the_same_once(spark, rows, monkeypatch):
    columns = "id long, clustered array<long>, data_sources array<string>, sources_int long, label string, artist string, album string, number string, year int, length int, ata string"
    made = [(i, [i], ["1" if i % 3 else "5"], 1 if i % 3 else 16, "some song", "band", f"album {i % 4}", "1", 2000, 100, f"band some song album {i % 4}") for i in range(120)]
    df, seen, cross = spark.createDataFrame(made, columns).cache(), [], blocking.cross_pairs

    def watched(*args):
        seen.append(cross(*args).count())
        return cross(*args)

    monkeypatch.setattr(blocking, "cross_pairs", watched)
    config = workflows.Config(domain="music", block_length=40, merge_least=0.9)
    got = workflows.add_source(df.where("sources_int <> 16"), df.where("sources_int = 16"), config, 16)
    # the smallest ids of each album meet: 0 with 4, 9 with 1, 6 with 2, 3 with 7
    pairs = [(r["id"], sorted(r["clustered"])) for r in got.where("size(clustered) > 1").collect()]
    assert sorted(pairs) == [(0, [0, 4]), (1, [1, 9]), (2, [2, 6]), (3, [3, 7])]
    assert got.count() == 116 and seen == [16]


def test_closed_links_are_scored_once_a_look(spark, rows, monkeypatch):
    made = [(i, str(1 + i % 5), 1 << i % 5, None if i % 11 == 0 else ("abc", "xyz", "mnop")[i % 3]) for i in range(60)]  # similarities of 0 and 1, whose means are exact
    df = spark.createDataFrame(made, "id long, data_source string, sources_int long, ata string").cache()
    edges = spark.createDataFrame([(i, i + 2) for i in range(0, 57)], "src long, dst long").cache()
    config, scored, score = workflows.Config(), [], links.with_similarity
    whole = score(blocking.all_edges(df.withColumn("c", F.col("id") % 2).where("id < 59"), "c"), df, "music", "ct", None).select("src", "dst", "agg_sim")
    want = rows(links.filter_clustering(whole, df))

    def watched(pairs, *args):
        scored.append(pairs.count())
        return score(pairs, *args)

    monkeypatch.setattr(links, "with_similarity", watched)
    assert rows(workflows.close_links(df, edges, config)) == want and want
    assert scored == [33]  # four looks in each of two components, and a row alone


def test_values_of_a_block_are_compared_once(spark, rows):
    """pairs of rows take their similarities from pairs of values, nulls and equal values included."""
    data = [(i, "xy"[i % 2], ("red ring", "red rings", None, "blue bolt")[i // 2 % 4], i % 3 or None) for i in range(40)]
    df = spark.createDataFrame(data, "id long, block string, label string, year int")
    found = blocking.pairs(df, "block")
    sims = {"label": similarity.string_sim, "year": similarity.near_sim}
    got, known = links.with_value_sims(found, df, "block", sims)
    assert set(known) == {"label", "year"}
    want = found.select("src", "dst", *(f(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) for c, f in sims.items()))
    assert rows(got.select("src", "dst", *(x.alias(c) for c, x in known.items()))) == rows(want)
    # values of their own are left to the pairs
    assert links.with_value_sims(found, df.withColumn("label", F.col("id").cast("string")), "block", {"label": similarity.string_sim})[1] == {}


def test_spanning_edges_leave_the_components(spark, rows):
    """of the links of a group that is alike throughout, fewer than its rows leave a task."""
    found = [(a, b, (a - b) % 3 == 0) for a in range(60) for b in range(a + 1, 60)]
    edges = spark.createDataFrame(found, "u long, v long, linked boolean").coalesce(1)
    thin = components.spanning(edges)
    assert thin.count() == 57
    assert rows(components.stars(thin), "node", "component") == [(i, i % 3) for i in sorted(range(3, 60), key=lambda i: repr((i, i % 3)))]


def test_links_of_a_block_are_filtered_by_looks():
    """the greedy filter over looks keeps what the one over all links keeps."""
    for seed in range(60):
        draw = random.Random(seed)
        rows = [(i, 1 << (s := draw.randrange(5)), str(s), draw.randrange(4)) for i in range(draw.randrange(2, 40))]
        first = {look: min(r[0] for r in rows if r[3] == look) for look in {r[3] for r in rows}}
        rows = [(i, m, s, first[look]) for i, m, s, look in rows]
        sims = [(a, b, draw.choice([0.7, 0.8, 1.0])) for a in first.values() for b in first.values() if a <= b and draw.random() < 0.8]
        known = {(x, y): sim for a, b, sim in sims for x, y in ((a, b), (b, a))}
        edges = [(p[0], q[0], known[p[3], q[3]]) for p in rows for q in rows if p[0] < q[0] and p[2] != q[2] and (p[3], q[3]) in known]
        edges.sort(key=lambda e: (-e[2], e[0], e[1]))
        assert links.greedy_looks(rows, sims) == links.greedy_disjoint(edges, {r[0]: r[1] for r in rows})


def test_pairs_of_shared_keys_come_once_without_an_aggregate(spark, rows):
    """a pair comes from the first family whose key it shares; long families give the same pairs."""
    sets = spark.createDataFrame([(i, [b for b in range(12) if (i * 37 >> b % 5) + b * i & 3 == 1]) for i in range(30)], "id long, bits array<int>")
    positions = [[0, 1, 2], [3, 4, 5, 6], [1, 7, 8, 9]]
    found = blocking.lsh_pairs(sets, positions)
    want = blocking.pairs(blocking.lsh_keys(sets, positions), ["family", "key"]).select("src", "dst").distinct()
    assert rows(found) == rows(want) and found.count() > 10
    assert "keys=[src" not in found._jdf.queryExecution().executedPlan().toString()
    assert "keys=[src" in want._jdf.queryExecution().executedPlan().toString()


def test_word_pairs_are_counted_where_they_meet(spark, monkeypatch):
    """shared words against brute force, over many small groups, with copies, repeated and null ids; no pair is sent between tasks."""
    monkeypatch.setattr(blocking, "GROUP_WORDS", 40)
    rng = random.Random(5)
    lists = [(k, sorted(rng.sample("abcdefghijkl", rng.randrange(1, 6)))) for k in range(60)] + [(k, ["a", "b", "c"]) for k in range(100, 130)]
    lists += [(7, ["a", "z"]), (7, ["a", "b"]), (None, ["a", "b"]), (200, ["lone", "words"])]
    for kind in (int, str):
        flat = [(None if i is None else kind(i), w) for i, ws in lists for w in ws]
        words = spark.createDataFrame([*flat, (kind(3), None)], f"id {'long' if kind is int else 'string'}, word string")
        want = Counter((i, j) for i, w in flat for j, v in flat if None not in (i, j) and i < j and w == v)
        for support in (1, 2, 3):
            found = blocking.word_pairs(words, support)
            assert sorted(map(tuple, found.collect())) == sorted((i, j, n) for (i, j), n in want.items() if n >= support)
        assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    few = blocking.word_pairs(words, 1, most_rows=20)
    held = Counter(w for i, w in flat if i is not None)
    assert {(r["src"], r["dst"]) for r in few.collect()} == {(i, j) for i, w in flat for j, v in flat if None not in (i, j) and i < j and w == v and held[w] <= 20}
    assert blocking.word_pairs(words.limit(0)).count() == 0


def test_shared_words_in_small_steps(monkeypatch):
    """The same pairs, however few are counted at once."""
    rng = random.Random(6)
    lists = [sorted(rng.choices(range(9), k=rng.randrange(6))) for _ in range(30)]

    def side(of):
        return overlap.Side(np.array(of), np.array([w for k in of for w in lists[k]], np.int32), np.cumsum([0, *(len(lists[k]) for k in of)]))

    even, odd = range(0, 30, 2), range(1, 30, 2)
    for counted, places, batch in ((1, 1, 1), (7, 20, 3), (10**6, 10**6, 10**6)):
        for name, value in (("COUNTED", counted), ("PLACES", places), ("BATCH", batch)):
            monkeypatch.setattr(overlap, name, value)
        one = side(even)
        for two, ks in ((side(odd), odd), (one, even)):
            got = sorted(tuple(map(int, t)) for some in overlap.row_pairs(one, two, 2) for t in zip(*some, strict=True))
            counts = ((min(a, b), max(a, b), sum(x == y for x in lists[a] for y in lists[b])) for a in even for b in ks if two is not one or a < b)
            assert got == sorted(c for c in counts if c[2] >= 2)


def test_rows_that_look_the_same_are_filtered_before_their_block(spark, rows):
    """the links of whole blocks over looks are those of all pairs, with looks that are equal to the similarity, and without an ata."""
    draw = random.Random(8)
    names = ["red ring large", "red ring larger", "Red, ring large", "red rings large", "blue bolt", "blue bolts small", None, "--"]
    own = [(i, 1 << (s := draw.randrange(5)), str(s), draw.choice("xy"), draw.choice(names)) for i in range(400)]
    df = spark.createDataFrame(own, "id long, sources_int long, data_source string, block string, ata string")
    found, large = links.filter_blocks(df, "block", ("ata",), "music", "ct", 0.6)
    edges = blocking.pairs(df, "block", blocking.disjoint()).select("src", "dst")
    want = links.filter_basic(links.with_similarity(edges, df, "music", "ct", 0.6), df)
    assert large.count() == 0 and rows(found, "src", "dst", "agg_sim") == rows(want, "src", "dst", "agg_sim")


def test_rows_of_one_look_take_the_next_that_fit():
    """what rows of one look leave, with their clusters, goes on as if all had been filtered at once."""
    for seed in range(40):
        draw = random.Random(seed)
        own = [(i, 1 << (s := draw.choice([0, 1, 1, 2, 3])), s) for i in range(draw.randrange(1, 40))]
        found, left = links.greedy_same(own)
        want = links.greedy_looks([(i, m, str(s), 0) for i, m, s in own], [(0, 0, 1.0)])
        assert sorted(found) == sorted(w[:2] for w in want)
        clusters = {i: c for i, _, c in left}
        assert all(clusters[a] == clusters[b] for a, b in found) and sorted(clusters) == [r[0] for r in own]


def test_trigram_sims_are_those_of_the_scalar_function():
    from kinweave.functions import scalar

    draw = random.Random(9)
    strings = ["", "a", "aaaa aaa", *("".join(draw.choices("ab c", k=draw.randrange(1, 12))) for _ in range(60))]
    got = {(i, j): s for i, j, s in zip(*(x.tolist() for x in links.gram_sims(strings, 0.3)), strict=True)}
    want = {(i, j): s for i in range(len(strings)) for j in range(i, len(strings)) if (s := scalar.cosine_trigram(strings[i], strings[j])) > 0.3001}
    assert all(abs(got[p] - s) < 2e-6 for p, s in want.items()) and all(s > 0.3 for s in got.values())


def test_dense_keys_are_compared_where_groups_meet(spark, monkeypatch, rows):
    """the same pairs, once each, by groups as by blocks; empty keys meet none, and nothing is joined."""
    monkeypatch.setattr(blocking, "GROUP_KEYS", 7)
    monkeypatch.setattr(blocking, "TILE", 3)
    sets = spark.createDataFrame([(i * 7 % 90, [b for b in range(12) if (i * 37 >> b % 5) + b * i & 3 == 1]) for i in range(45)], "id long, bits array<int>")
    positions = [[0, 1, 2], [3, 4, 5, 6], [1, 7, 8, 9]]
    want = blocking.pairs(blocking.lsh_keys(sets, positions), ["family", "key"]).select("src", "dst").distinct()
    for dense in (0, 10**9):
        monkeypatch.setattr(blocking, "DENSE", dense)
        found = blocking.lsh_pairs(sets, positions)
        assert rows(found) == rows(want) and found.count() > 10
        assert ("Join" in found._jdf.queryExecution().executedPlan().toString()) == (dense == 0)
