"""Operators on small graphs with known results."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity
from kinweave.operators import blocking, components, corruption, evaluation, filters, groups, links, merging, representatives


def vertices(spark, *more, schema="id long, data_source string, sources_int long"):
    return spark.createDataFrame(list(more), schema)


def test_components(spark, rows):
    random.seed(1)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {v: v for v in range(140)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = components.with_components(spark.range(140), spark.createDataFrame(edges, "src long, dst long"))
    assert dict(rows(found, "id", "cc_id")) == {v: root(v) for v in range(140)}


def test_no_edges(spark, rows):
    found = components.with_components(spark.range(3), spark.createDataFrame([], "src long, dst long"))
    assert rows(found, "id", "cc_id") == [(0, 0), (1, 1), (2, 2)]


def test_split_pairs_are_all_pairs(spark, rows):
    random.seed(2)
    df = spark.createDataFrame([(i, random.choice("aaaaaab"), 1 << random.randrange(5)) for i in range(80)], "id long, k string, sources_int long").cache()
    for limit in (1, 3, 1000):
        assert rows(blocking.split_pairs(df, "k", None, limit), "src", "dst") == rows(blocking.pairs(df, "k"), "src", "dst")
    assert rows(blocking.split_pairs(df, "k", blocking.disjoint(5), 4), "src", "dst") == rows(blocking.pairs(df, "k", blocking.disjoint(5)), "src", "dst")


def test_small_limits_cut_a_block_into_few_parts(spark, rows):
    sizes = spark.createDataFrame([(6000,), (100,), (30_000,)], "n long")
    assert rows(sizes.select("n", blocking._parts(F.col("n"), 20).alias("m"))) == [(100, 5), (30_000, 30), (6000, 8)]
    assert rows(sizes.select("n", blocking._parts(F.col("n"), 1000).alias("m"))) == [(100, 1), (30_000, 30), (6000, 6)]
    df = spark.range(300).withColumn("k", F.lit("a"))
    assert rows(blocking.split_pairs(df, "k", None, 20), "src", "dst") == sorted(((a, b) for a in range(300) for b in range(a + 1, 300)), key=repr)


def test_lonely_rows_of_two_sides_come_from_the_blocks(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, None, 2), (5, "c", 2), (6, "a", 2), (7, None, 1)], "id long, k string, sources_int long")
    found = blocking.two_sided(df, "k", 2)
    assert rows(found, "src", "dst") == [(1, 2), (1, 6), (3, 3), (4, 4), (5, 5), (7, 7)]
    # the pairs are made once
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


def test_quality_of_links_is_that_of_the_pairs(spark, rows):
    random.seed(7)
    df = spark.createDataFrame([(i, random.choice(["a", "b", "c", None])) for i in range(40)], "id long, k string").cache()
    for n in (0, 60):
        made = spark.createDataFrame([(random.randrange(44), random.randrange(44)) for _ in range(n)], "a long, b long").cache()
        found = evaluation.sorted_pairs(made, "a", "b")
        assert rows(evaluation.quality_of_links(df, "k", found)) == rows(evaluation.quality(evaluation.gold_pairs(df, "k"), found))


def test_blocks_are_assigned_by_values(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        x, y = rng.integers(0, 6, rng.integers(1, 9)), rng.integers(0, 6, rng.integers(1, 9))
        cost = 1 - np.round(1 / (1 + abs(x[:, None] - y[None, :])), 6)
        of = merging.assign(cost)
        (u, n), (v, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
        flow = merging.transport(1 - np.round(1 / (1 + abs(u[:, None] - v[None, :])), 6), n, m)
        assert flow.min() >= 0 and flow.sum() == min(len(x), len(y)) and (flow.sum(1) <= n).all() and (flow.sum(0) <= m).all()
        assert abs((flow * (1 - np.round(1 / (1 + abs(u[:, None] - v[None, :])), 6))).sum() - sum(cost[i, j] for i, j in enumerate(of) if j >= 0)) < 1e-9
    left = spark.createDataFrame([(i, "ab"[i % 2], i % 7) for i in range(40)] + [(90, "z", 1)], "id long, k string, v int").cache()
    right = spark.createDataFrame([(100 + i, "ab"[i % 2], i % 5 + 3) for i in range(30)] + [(190, None, 1)], "id long, k string, v int").cache()
    sim = F.round(1 / (1 + F.abs(F.col("s.v") - F.col("t.v"))), 6)
    want = merging.assign_pairs(blocking.cross_pairs(left, right, "k").select("src", "dst", sim.alias("sim")), unmatched=True).collect()
    got = merging.assign_blocks(left, right, "k", "v", sim, unmatched=True).collect()
    ends = lambda found: sorted(x for r in found for x in {r["src"], r["dst"]})
    assert len(got) == len(want) and ends(got) == ends(want) == sorted([*range(40), *range(100, 130)])
    assert abs(sum(r["sim"] for r in got) - sum(r["sim"] for r in want)) < 1e-9
    with pytest.raises(ValueError, match="beyond"):
        merging.assign_blocks(left, right, "k", "v", sim, task_cells=3)


def test_new_source_pairs_are_the_accepted_pairs(spark, rows):
    random.seed(5)
    df = spark.createDataFrame([(i, random.choice("aab"), random.choice([0, 1, 2, 3, 16, 16, 17])) for i in range(90)], "id long, k string, sources_int long").cache()
    columns = ["src", "dst", "s", "t", "k"]
    assert rows(blocking.new_source_pairs(df, "k", 16), *columns) == rows(blocking.pairs(df, "k", blocking.with_new_source(16)), *columns)


def test_nearest_pairs_hold_all_that_max_both_chooses(spark, rows):
    random.seed(6)
    df = spark.createDataFrame([(i, random.choice(["a", "a", "b", None]), random.choice([None, 0, 1, 2, 3, 4, 7, 9])) for i in range(150)], "id long, k string, length int").cache()
    sim = similarity.near_sim(F.col("s.length"), F.col("t.length")).alias("sim")
    every = blocking.pairs(df, "k").select("src", "dst", sim)
    some = blocking.nearest_pairs(df, "k", "length").select("src", "dst", sim)
    assert rows(links.max_both(some)) == rows(links.max_both(every))
    assert some.count() <= 10 * 150 < every.count()


def test_lonely_rows_meet_themselves(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "id long, k string, sources_int long")
    assert rows(blocking.with_lonely(df, blocking.pairs(df, "k"), "k"), "src", "dst") == [(1, 2), (3, 3)]
    assert rows(blocking.two_sided(df, "k", 2), "src", "dst") == [(1, 2), (3, 3)]
    with pytest.raises(Exception, match="holds the new source"):
        blocking.two_sided(spark.createDataFrame([(1, "a", 3)], "id long, k string, sources_int long"), "k", 2).collect()


def test_group_edges(spark, rows):
    df = spark.createDataFrame([(i, i % 3) for i in range(11)], "id long, k int")
    assert len(rows(blocking.simple_edges(df, "k"))) == 8
    assert len(rows(blocking.all_edges(df, "k"))) == 6 + 6 + 3
    one = spark.createDataFrame([([3, 1, 2, 2],)], "clustered array<long>")
    assert rows(blocking.cluster_pairs(one)) == [(1, 2), (1, 3), (2, 3)]


def test_basic_link_filter(spark, rows):
    v = vertices(spark, (4, "a", 3), (7, "b", 6), (10, "c", 4))
    e = spark.createDataFrame([(4, 10, 0.8), (4, 7, 0.9), (7, 10, 0.7)], "src long, dst long, agg_sim double")
    assert rows(links.filter_basic(e, v), "src", "dst") == [(4, 10)]


def test_link_filter_by_rounds_is_the_greedy_one(spark, rows):
    random.seed(3)
    v = [(i, "x", 1 << random.randrange(4)) for i in range(40)]
    e = {(a, b): round(random.random(), 1) for a, b in (sorted(random.sample(range(40), 2)) for _ in range(90))}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in e.items()], "src long, dst long, agg_sim double")
    want = rows(links.filter_basic(df, vertices(spark, *v)), "src", "dst")
    assert rows(links.filter_basic(df, vertices(spark, *v), task_edges=3), "src", "dst") == want
    masks = {i: m for i, _, m in v}
    order = sorted(((a, b, s) for (a, b), s in e.items()), key=lambda x: (-x[2], x[0], x[1]))
    assert sorted(((a, b) for a, b, _ in links.greedy_disjoint(order, masks)), key=repr) == want


def test_clustering_link_filter_keeps_the_best(spark, rows):
    v = vertices(spark, (1, "a", 1), (2, "b", 2), (3, "b", 2))
    e = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (2, 3, 0.4)], "src long, dst long, agg_sim double")
    assert rows(links.filter_clustering(e, v), "src", "dst") == [(1, 2)]
    assert rows(links.filter_clustering(e, v, reference_compat=True)) == []


def test_cleaning(spark, rows):
    v = spark.createDataFrame([(1, "a", ["School"]), (2, "b", ["no_type"]), (3, "a", ["Park"]), (4, "c", ["ArchitecturalStructure"])], "id long, data_source string, types array<string>")
    e = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (3, 4), (1, 9), (1, 2)], "src long, dst long")
    assert rows(links.between_sources(e, v)) == [(1, 2), (1, 4), (3, 4)]
    assert rows(links.with_known_ends(e, v)) == [(1, 2), (1, 3), (1, 4), (3, 4)]
    assert rows(links.of_equal_types(e, v)) == [(1, 2), (1, 4)]
    assert rows(links.linked(v, e.where("dst = 2")), "id") == [(1,), (2,)]
    assert rows(links.support(e, 2), "src", "dst") == [(1, 2)]


def test_sim_sort_splits_the_weak_one(spark, rows):
    v = spark.createDataFrame([(i, 7) for i in (2756, 2757, 5564, 6645)], "id long, hash_cc long")
    sims = {(2756, 5564): 0.95, (2756, 6645): 0.9, (5564, 6645): 0.9, (2756, 2757): 0.7, (2757, 5564): 0.7, (2757, 6645): 0.6}
    e = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "src long, dst long, agg_sim double")
    got = {r["id"]: r for r in groups.sim_sort(v, e, 0.8).collect()}
    assert [i for i, r in got.items() if not r["status"]] == [2757]
    assert got[2757]["old_hash_cc"] == 7 and got[2757]["hash_cc"] != 7


def test_untyped_joins_best_typed_neighbour(spark, rows):
    v = spark.createDataFrame([(1, 10, ["Park"]), (2, 20, ["Island"]), (3, 30, ["no_type"]), (4, 5, ["no_type"]), (5, 50, ["no_type"])], "id long, hash_cc long, types array<string>")
    e = spark.createDataFrame([(1, 3, 0.8), (2, 3, 0.8), (4, 5, 0.9)], "src long, dst long, agg_sim double")
    assert rows(groups.to_typed_neighbour(v, e), "id", "hash_cc") == [(1, 10), (2, 20), (3, 10), (4, 50), (5, 50)]


def test_type_groups(spark, rows):
    v = spark.createDataFrame([(1, 1, ["School"]), (2, 1, ["ArchitecturalStructure", "Park"]), (3, 1, ["Park"]), (4, 1, ["Island"]), (5, 1, ["no_type"])], "id long, cc_id long, types array<string>")
    assert rows(groups.by_types(v), "id", "group_id") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert {g for _, g in rows(groups.by_types(v, True), "id", "group_id")} == {1}


def test_majority(spark, rows):
    df = spark.createDataFrame([(1, "x"), (1, "yy"), (2, "x"), (2, "x"), (2, "yyy"), (3, None)], "k int, v string")
    assert rows(representatives.majority(df, "k", F.col("v"), "m")) == [(1, "yy"), (2, "x")]


def test_place_representative_prefers_sources(spark):
    df = spark.createDataFrame(
        [(5, 1, "Dresden", 1.0, 2.0, "http://dbpedia.org/", 2, ["Settlement"], [5]), (3, 1, "dresden", 3.0, 4.0, "http://sws.geonames.org/", 16, ["Country"], [3]), (9, 1, "L", 95.0, 0.0, "http://data.nytimes.com/", 1, ["Settlement"], [9])],
        "id long, hash_cc long, label string, lat double, lon double, data_source string, sources_int long, types array<string>, clustered array<long>",
    )
    r = representatives.places(df).head()
    assert (r["id"], r["label"], r["lat"], r["clustered"], r["sources_int"], r["types"]) == (3, "dresden", 3.0, [3, 5, 9], 19, ["Country", "Settlement"])


def test_max_both(spark, rows):
    p = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.95), (2, 11, 0.99), (2, 10, 0.1)], "src long, dst long, sim double")
    assert rows(links.max_both(p), "src", "dst") == [(2, 11)]


def test_assignment():
    cost = np.array([[0.1, 0.3, 0.2, 0.4], [0.3, 0.4, 0.1, 0.2], [0.4, 0.2, 0.3, 0.1], [0.3, 0.2, 0.1, 0.4]])
    assert merging.assign(cost) == [0, 2, 3, 1]
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        cost = rng.integers(0, 9, (n, m)).astype(float)
        got = merging.assign(cost)
        total = sum(cost[i, j] for i, j in enumerate(got) if j >= 0)
        k = min(n, m)
        best = min(sum(cost[i, j] for i, j in zip(r, c, strict=True)) for r in itertools.combinations(range(n), k) for c in itertools.permutations(range(m), k))
        assert total == best and sum(j >= 0 for j in got) == k


def test_assign_pairs(spark, rows):
    p = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.8), (3, 12, 0.5)], "src long, dst long, sim double")
    assert rows(merging.assign_pairs(p), "src", "dst") == [(1, 11), (2, 10), (3, 12)]


def test_cliques(spark, rows):
    edges = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]
    assert merging.cliques(range(7), edges) == [[0, 1, 2, 3], [3, 4], [4, 5, 6]]
    got = merging.maximal_cliques(spark.range(7), spark.createDataFrame(edges, "src long, dst long"))
    assert len(rows(got)) == 3


def test_greedy_merge_respects_sources(spark, rows):
    schema = "id long, clustered array<long>, sources_int long, label string, artist string, album string, number string, year int, length int"
    data = [(1, [1], 1, "abc def", "", "", "1", 2000, 100), (2, [2], 2, "abc def", "", "", "1", 2000, 100), (3, [3], 1, "abc def", "", "", "1", 2000, 100), (4, [4], 4, "abc deg", "", "", "1", 2000, 101), (5, [5], 8, "zzz", "", "", "9", 1950, 7)]
    got = merging.merge_clusters(spark.createDataFrame(data, schema), "music", 0.7, 5)
    assert rows(got, "id", "clustered", "sources_int") == [(1, [1, 2, 4], 7), (3, [3], 1), (5, [5], 8)]


@pytest.mark.parametrize("domain", ["music", "geo"])
def test_merge_by_steps_is_the_greedy_one(spark, rows, domain):
    rng = random.Random(9)
    data = [(i, [i], 1 << rng.randrange(5), rng.choice(["abc def", "abc deg", "abd def", "xbc def"]), rng.choice(["1", "2"]), rng.randrange(3), rng.randrange(3), 1.0 + rng.randrange(3) / 10, 2.0, rng.randrange(3)) for i in range(14)]
    df = spark.createDataFrame(data, "id long, clustered array<long>, sources_int long, label string, number string, year int, length int, lat double, lon double, types_int long").withColumn("artist", F.lit("")).withColumn("album", F.lit(""))
    columns = ["id", "clustered", "sources_int", "label"]
    want = rows(merging.merge_clusters(df, domain, 0.6, 4, 0 if domain == "geo" else 1), *columns)
    assert rows(merging.merge_clusters(df, domain, 0.6, 4, 0 if domain == "geo" else 1, task_pairs=2), *columns) == want
    assert len(want) < 14


def test_words(spark, rows):
    df = spark.createDataFrame([(1, "The cat sat cat"), (2, "cat dog"), (3, "x1 bird dog"), (4, None)], "id long, label string")
    words = blocking.document_words(df)
    assert rows(words) == [(1, "cat"), (1, "sat"), (2, "cat"), (2, "dog"), (3, "bird"), (3, "dog")]
    idf = blocking.inverse_frequencies(words)
    assert {w: round(10**i) for w, _, i in rows(idf)} == {"cat": 3, "dog": 3, "sat": 6, "bird": 6}
    assert rows(blocking.word_pairs(blocking.top_words(words, idf), 1), "src", "dst") == [(1, 2), (2, 3)]


def test_positions_are_javas():
    # the first values of java.util.Random(42).nextInt(10)
    r = blocking.JavaRandom(42)
    assert [r.below(10) for _ in range(5)] == [0, 3, 8, 4, 0]
    found = blocking.sampled_positions(2, 5, 100)
    assert all(len(set(f)) == 5 for f in found) and found[0] != found[1]


def test_lsh_finds_equal_sets(spark, rows):
    df = spark.createDataFrame([(1, "small red gear"), (2, "small red gear"), (3, "blue box")], "id long, label string")
    sets, _ = blocking.trigram_ids(df)
    assert (1, 2) in rows(blocking.lsh_pairs(sets, blocking.sampled_positions(15, 3, 20)))


def test_corruption(spark, rows):
    assert rows(corruption.added_edges(spark.range(12), 5)) == [(0, 4), (5, 9)]
    e = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    assert rows(corruption.without_every(e, 3)) == [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (6, 7)]


def test_quality(spark):
    gold = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    r = evaluation.quality(gold, spark.createDataFrame([(1, 2), (4, 5)], "src long, dst long")).head()
    assert (r["tp"], r["n_found"], r["n_gold"], r["precision"], r["recall"], r["f1"]) == (1, 2, 3, 0.5, 0.3333, 0.4)
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y")], "id long, g string, f string")
    r = evaluation.quality_of_clusters(df, "g", "f").head()
    assert (r["tp"], r["n_found"], r["n_gold"]) == (1, 2, 3)


def test_rejoin(spark, rows):
    schema = "id long, label string, lat double, lon double, types array<string>, hash_cc long, old_hash_cc long"
    data = [(395207, "Chad", 15.0, 19.0, ["Country"], 1, 100), (513732, "Chad", 15.1, 19.0, ["Country"], 2, 100), (7, "Peru", -9.0, -75.0, ["Country"], 3, 100), (8, "Chad", 15.0, 19.0, ["Country"], 4, None)]
    assert rows(merging.rejoin(spark.createDataFrame(data, schema)), "id", "hash_cc") == [(395207, 1), (513732, 1), (7, 3), (8, 4)]


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, "a", None, [1], 1), (2, None, ["a", "b"], [2, 3], 3), (4, None, ["c"], [4], 4), (5, None, None, [5], 0)], "id long, data_source string, data_sources array<string>, clustered array<long>, sources_int long")
    assert rows(filters.of_source(df, "a"), "id") == [(1,), (2,)]
    assert rows(filters.of_sources(df, ["b", "c"]), "id") == [(2,), (4,)]
    assert rows(filters.of_size(df, 2), "id") == [(2,)]
    assert rows(filters.with_room(df, 2), "id") == [(1,), (4,), (5,)]
    assert rows(filters.sources(df.where("data_sources IS NOT NULL"))) == [("a",), ("b",), ("c",)]
    assert rows(filters.of_ids(df, spark.createDataFrame([(4,)], "id long")), "id") == [(4,)]
    p = blocking.pairs(df.select("id", "sources_int").withColumn("k", F.lit(1)), "k")
    assert rows(filters.new_source_last(p.where("src = 1 AND dst = 4"), 1), "src", "dst") == [(4, 1)]
    assert rows(filters.smaller_first(filters.new_source_last(p.where("src = 1 AND dst = 4"), 1)), "src", "dst") == [(1, 4)]
    assert rows(filters.ends(p.where("src = 1")), "id") == [(1,), (2,), (4,), (5,)]
    assert rows(filters.transitions(p.where("src = 1 AND dst = 4"))) == [(1, 1), (4, 1)]
    sims = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, sim double")
    assert rows(filters.at_least(sims, 0.7), "id") == [(2,)]


def test_bloom_filters(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").select("a", "b", blocking.bloom_bits(F.col("a")).alias("x"), blocking.bloom_bits(F.col("b")).alias("y"))
    r = df.select(blocking.bloom_union(F.col("x"), F.col("y")).alias("u"), blocking.bloom_intersection(F.col("x"), F.col("y")).alias("i"), blocking.bloom_difference(F.col("x"), F.col("y")).alias("d"), "x", "y", blocking.may_hold(blocking.bloom_union(F.col("x"), F.col("y")), F.col("a")).alias("h")).head()
    assert set(r["u"]) == {*r["x"], *r["y"]} and set(r["i"]) == {*r["x"]} & {*r["y"]} and set(r["d"]) == {*r["x"]} ^ {*r["y"]} and r["h"]
