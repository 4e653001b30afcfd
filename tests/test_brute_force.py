"""Operators that SQL can't express, against plain implementations on random small graphs, and their queries on small tables."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import scalar
from kinweave.operators import blocking, links, merging
from kinweave.plans import registry


def plain_filter(edges, masks):
    """Best first: a link stays if the groups that it would join hold no source twice. Groups are sets, searched one by one."""
    groups, kept = [{v} for v in masks], []
    for src, dst, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = (next(g for g in groups if x in g) for x in (src, dst))
        held = [masks[x] for x in a | b]
        if a is not b and all(x & y == 0 for x, y in itertools.combinations(held, 2)):
            groups = [g for g in groups if g is not a and g is not b] + [a | b]
            kept.append((src, dst))
    return sorted(kept)


def test_link_filter_on_random_graphs(spark):
    """100 graphs at once, as components of one: each by one task, and all by rounds of joins."""
    rng = random.Random(21)
    masks, edges, want = {}, [], []
    for g in range(100):
        n = rng.randrange(2, 12)
        own = {g * 100 + i: 1 << rng.randrange(4) for i in range(n)}
        pairs = {tuple(sorted(rng.sample(sorted(own), 2))) for _ in range(rng.randrange(1, 3 * n))}
        some = [(a, b, rng.randrange(5) / 4) for a, b in pairs]
        masks |= own
        edges += some
        want += plain_filter(some, own)
    e = spark.createDataFrame(edges, "src long, dst long, agg_sim double")
    v = spark.createDataFrame(list(masks.items()), "id long, sources_int long")
    for task_edges in (50_000, 6):
        got = sorted((r["src"], r["dst"]) for r in links.filter_basic(e, v, task_edges).collect())
        assert got == sorted(want)


def plain_merge(domain, records, pairs, least, most):
    """The published iteration, each step written out: all pairs of the highest similarity that share no end, in the order of ids
    (places: the first alone); pairs of merged clusters are led to the new ones and scored anew."""
    clusters, open_ = {r["id"]: r for r in records}, {tuple(sorted(p[:2])): p[2] for p in pairs}
    while open_:
        top = max(open_.values())
        chosen = []
        for a, b in sorted(p for p, s in open_.items() if s == top):
            if not any({a, b} & {*p} for p in chosen):
                chosen.append((a, b))
        if domain == "geo":
            chosen = chosen[:1]
        to = {x: min(p) for p in chosen for x in p}
        for a, b in chosen:
            new = merging.merged_records(domain, clusters.pop(a), clusters.pop(b))
            clusters[new["id"]] = new
        moved = {tuple(sorted((to.get(a, a), to.get(b, b)))) for a, b in open_ if a in to or b in to}
        open_ = {p: s for p, s in open_.items() if p[0] not in to and p[1] not in to}
        for a, b in moved:
            if a == b:
                continue
            r, s = clusters[a], clusters[b]
            if r["sources_int"] & s["sources_int"] or not r["sources_int"] or not s["sources_int"] or r["sources_int"].bit_count() + s["sources_int"].bit_count() > most:
                continue
            if domain == "geo" and r["types_int"] and s["types_int"] and not r["types_int"] & s["types_int"]:
                continue
            sim = scalar.merge_sim(domain, r, s)
            if sim >= least:
                open_[a, b] = sim
    return sorted((r["id"], tuple(r["clustered"]), r["sources_int"], r["label"]) for r in clusters.values())


def plain_blocks(domain, records, least, most, key):
    """plain_merge() in each block, with all pairs that may merge as candidates."""
    out = []
    blocks = {}
    for r in records:
        blocks.setdefault(key(r), []).append(dict(r, block=key(r)))
    for some in blocks.values():
        pairs = []
        for r, s in itertools.combinations(sorted(some, key=lambda r: r["id"]), 2):
            m, n = r["sources_int"], s["sources_int"]
            if not m or not n or m & n or m.bit_count() + n.bit_count() > most or m.bit_count() >= most or n.bit_count() >= most:
                continue
            if domain == "geo" and r["types_int"] and s["types_int"] and not r["types_int"] & s["types_int"]:
                continue
            sim = scalar.merge_sim(domain, r, s)
            if sim >= least:
                pairs.append((r["id"], s["id"], sim))
        out += plain_merge(domain, some, pairs, least, most)
    return sorted(out)


def random_clusters(rng, n, start=0):
    labels = ["abc def", "abc deg", "abd def", "xbc def", "abc def ghi", ""]
    return [
        {"id": start + i, "clustered": [start + i], "sources_int": 1 << rng.randrange(5), "label": rng.choice(labels), "artist": rng.choice(["a", "b"]), "album": "", "number": rng.choice(["1", "2"]), "year": rng.randrange(3), "length": rng.randrange(3),
         "lat": 1.0 + rng.randrange(3) / 10, "lon": 2.0, "types_int": rng.randrange(3)}
        for i in range(n)
    ]


@pytest.mark.parametrize("domain", ["music", "nc", "geo"])
def test_greedy_merge_on_random_clusters(domain):
    rng = random.Random(22)
    for _ in range(100):
        records = [dict(r, block="") for r in random_clusters(rng, rng.randrange(2, 12))]
        pairs = []
        for r, s in itertools.combinations(records, 2):
            if r["sources_int"] & s["sources_int"] == 0 and (domain != "geo" or not r["types_int"] or not s["types_int"] or r["types_int"] & s["types_int"]):
                sim = scalar.merge_sim(domain, r, s)
                if sim >= 0.5:
                    pairs.append((r["id"], s["id"], sim))
        got = sorted((r["id"], tuple(r["clustered"]), r["sources_int"], r["label"]) for r in merging.greedy_merge(domain, records, pairs, 0.5, 4))
        assert got == plain_merge(domain, records, pairs, 0.5, 4)


SCHEMA = "id long, clustered array<long>, sources_int long, label string, artist string, album string, number string, year int, length int, lat double, lon double, types_int long"


@pytest.mark.parametrize("domain", ["music", "nc", "geo"])
def test_merges_in_spark_are_the_plain_ones(spark, domain):
    rng = random.Random(23)
    records = [r for b in range(6) for r in random_clusters(rng, 9, 100 * b)]
    df = spark.createDataFrame([tuple(r.values()) for r in records], SCHEMA)
    # one block for places (length 0); one letter of the names otherwise
    key = {"music": lambda r: r["label"][:1], "nc": lambda r: f"{r['label'][:1]:1}{r['artist'][:1]:1}", "geo": lambda r: ""}[domain]
    length = {"music": 1, "nc": 2, "geo": 0}[domain]
    want = plain_blocks(domain, records, 0.6, 4, key)
    for task_pairs in (50_000, 3):
        got = merging.merge_clusters(df, domain, 0.6, 4, length, task_pairs=task_pairs).collect()
        assert sorted((r["id"], tuple(r["clustered"]), r["sources_int"], r["label"]) for r in got) == want


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Tables of 40 parts and 30 suppliers, for whole queries."""
    out = str(tmp_path_factory.mktemp("tiny"))
    for name, n in (("part", 40), ("supplier", 30), ("nation", 25), ("region", 5)):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        df.orderBy(df.columns[0]).limit(n).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


def as_tuples(rows):
    return sorted((r["id"], tuple(map(int, r["clustered"].split(","))), r["sources_int"], r["label"]) for r in rows)


@pytest.mark.parametrize("domain", ["music", "nc", "geo"])
def test_merge_queries(spark, tiny, domain):
    """The registered merges, whole, against the plain iteration over the same rows."""
    from kinweave.functions import text, types
    from kinweave.sources import adapters

    if domain == "geo":
        rows = adapters.places(spark, tiny).withColumn("types_int", types.mask(F.col("types"))).withColumn("block", text.block_key("geo", 16)).collect()
    else:
        rows = adapters.parts(spark, tiny).withColumn("block", text.block_key(domain)).collect()
    records = [r.asDict() for r in rows]
    got = registry.QUERIES[f"merge_execution_{domain}"](spark, tiny).collect()
    least = 0.75 if domain == "geo" else 0.9
    assert as_tuples(got) == plain_blocks(domain, records, least, 5, lambda r: r["block"])


def plain_assignment(pairs):
    """The highest total similarity of all one-to-one choices of pairs, by trying them."""
    best = 0.0

    def go(i, left, right, total):
        nonlocal best
        best = max(best, total)
        if i < len(pairs):
            s, t, x = pairs[i]
            if s not in left and t not in right:
                go(i + 1, left | {s}, right | {t}, total + x)
            go(i + 1, left, right, total)

    go(0, frozenset(), frozenset(), 0.0)
    return best


def test_assignment_on_random_graphs(spark):
    rng = random.Random(24)
    pairs, want = [], 0.0
    for g in range(100):
        some = {(g * 100 + rng.randrange(4), g * 100 + 50 + rng.randrange(4)): rng.randrange(1, 9) / 8 for _ in range(rng.randrange(1, 9))}
        some = [(a, b, s) for (a, b), s in some.items()]
        want += plain_assignment(some)
        pairs += some
    df = spark.createDataFrame(pairs, "src long, dst long, sim double")
    got = merging.assign_pairs(df).collect()
    known = {(a, b): s for a, b, s in pairs}
    assert all(known[r["src"], r["dst"]] == r["sim"] for r in got)
    assert len({r["src"] for r in got}) == len({r["dst"] for r in got}) == len(got)
    assert abs(sum(r["sim"] for r in got) - want) < 1e-9
    whole = merging.assign_pairs(df, unmatched=True).collect()
    ends = [x for r in whole for x in {r["src"], r["dst"]}]
    assert sorted(ends) == sorted({x for a, b, _ in pairs for x in (a, b)}) and all(r["sim"] == 1 for r in whole if r["src"] == r["dst"])
    with pytest.raises(ValueError, match="smaller blocks"):
        merging.assign_pairs(df, task_cells=3)


def test_cliques_on_random_graphs(spark):
    rng = random.Random(25)
    edges, want = [], []
    for g in range(60):
        n = rng.randrange(2, 9)
        own = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(1, 20))}
        near = lambda a, b, own=own: (min(a, b), max(a, b)) in own
        full = [set(c) for k in range(2, n + 1) for c in itertools.combinations(range(n), k) if all(near(a, b) for a, b in itertools.combinations(c, 2))]
        want += [sorted(g * 100 + x for x in c) for c in full if not any(c < d for d in full)]
        edges += [(g * 100 + a, g * 100 + b) for a, b in own]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges[:20]], "src long, dst long")
    got = merging.maximal_cliques(spark.range(6000), df)
    assert sorted(r["clique"] for r in got.collect()) == sorted(want)


def test_words_and_hashing_in_workflows(spark):
    from kinweave.plans import workflows

    rng = random.Random(26)
    names = ["silver moon river", "moon river silver song", "blue river", "quick brown fox", "fox quick jumps", "lonely"]
    df = spark.createDataFrame([(i, rng.choice(names), "a", 1 << (i % 3)) for i in range(30)], "id long, label string, artist string, sources_int long")
    rows = df.collect()
    for strategy in ("idf", "lsh", "no", "standard", "block_split"):
        found = blocking.blocked(df, strategy, F.substring("label", 1, 4)).collect()
        assert len(found) == 30 and all(r["block"] is not None for r in found)
        blocks = {}
        for r in found:
            blocks.setdefault(r["block"], set()).add(r["id"])
        config = workflows.Config(blocking=strategy)
        pairs = {(r["src"], r["dst"]) for r in workflows.block_edges(df, config).collect()}
        of = {i: b for b, ids in blocks.items() for i in ids}
        want = {(r["id"], s["id"]) for r, s in itertools.combinations(rows, 2) if r["sources_int"] != s["sources_int"] and of[r["id"]] == of[s["id"]]}
        assert pairs == want if strategy != "standard" and strategy != "block_split" else pairs
    with pytest.raises(ValueError, match="no blocking strategy"):
        workflows.block_edges(df, workflows.Config(blocking="other"))
    with pytest.raises(ValueError, match="no step"):
        workflows.run_step("cluster_addition", workflows.Config(), df)


def plain_components(nodes, links_):
    label = {n: n for n in nodes}
    for a, b in links_:
        low, high = sorted((label[a], label[b]))
        label = {n: low if x == high else x for n, x in label.items()}
    return label


def plain_links(rows, edges):
    """Links between sources of a similarity over 0.6, best first, without two rows of a source in a group."""
    by = {r["id"]: r for r in rows}
    scored = [(a, b, scalar.string_sim(by[a]["ata"], by[b]["ata"])) for a, b in edges if by[a]["sources_int"] != by[b]["sources_int"]]
    return plain_filter([e for e in scored if e[2] > 0.6], {r["id"]: r["sources_int"] for r in rows})


@pytest.mark.parametrize("name", ["incremental_initial", "incremental_vertex"])
def test_initial_clustering_queries(spark, tiny, name):
    """Whole queries: all pairs of a block, scored, filtered, their components as clusters."""
    from kinweave.functions import text

    rows = [r.asDict() for r in registry._named_parts(spark, tiny).withColumn("block", text.block_key("music")).collect()]
    edges = [(r["id"], s["id"]) for r, s in itertools.combinations(sorted(rows, key=lambda r: r["id"]), 2) if r["block"] == s["block"]]
    label = plain_components([r["id"] for r in rows], plain_links(rows, edges))
    want = {}
    for r in rows:
        want.setdefault(label[r["id"]], []).append(r)
    want = sorted((cc, ",".join(str(r["id"]) for r in sorted(some, key=lambda r: r["id"])), sum(r["sources_int"] for r in some)) for cc, some in want.items())
    assert sorted((r["id"], r["clustered"], r["sources_int"]) for r in registry.QUERIES[name](spark, tiny).collect()) == want


def test_preprocessing_query(spark, tiny):
    from kinweave.sources import adapters

    rows = [r.asDict() for r in registry._named_parts(spark, tiny).collect()]
    edges = [(r["src"], r["dst"]) for r in adapters.part_edges(spark, tiny).collect()]
    label = plain_components([r["id"] for r in rows], plain_links(rows, edges))
    digest = lambda x: int.from_bytes(hashlib.md5(str(x).encode()).digest()[:8], "little", signed=True)
    got = registry.QUERIES["default_preprocessing"](spark, tiny).collect()
    assert sorted((r["id"], r["cc_id"], r["hash_cc"]) for r in got) == sorted((i, cc, digest(cc)) for i, cc in label.items())


def test_merge_init_query(spark, tiny):
    """Rows that left the same group, alike by two of label, place and type, come together under the smallest id."""
    from kinweave.sources import adapters

    alike = [{"ArchitecturalStructure", "School"}, {"Mountain", "Island"}, {"Country", "Settlement"}, {"Settlement", "AdministrativeRegion"}, {"AdministrativeRegion", "Country"}]
    rows = [r.asDict() for r in adapters.places(spark, tiny).collect()]
    found = []
    for r, s in itertools.combinations(sorted((r for r in rows if r["id"] % 2 == 0), key=lambda r: r["id"]), 2):
        if r["nation"] != s["nation"]:
            continue
        kinds = {r["types"][0], s["types"][0]}
        kind = None if "no_type" in kinds else float(len(kinds) == 1 or kinds in alike)
        name, place = scalar.string_sim(r["label"], s["label"]), scalar.place_sim(r, s)
        there = [x for x in (name, place, kind) if x is not None]
        mean = 0.0 if name is not None and name < 0.5 else round(sum(there) / len(there), 10)
        fine = lambda x: x is None or x > 0.7
        if mean > 0.5 and len(there) >= 2 or name is not None and name > 0.8 and fine(place) and fine(kind):
            found.append((r["id"], s["id"]))
    want = plain_components([r["id"] for r in rows], found)
    got = registry.QUERIES["merge_init"](spark, tiny).collect()
    assert sorted((r["id"], r["hash_cc"]) for r in got) == sorted(want.items())


def test_main_sources_query(spark, tiny):
    """Every cluster of two is a pair of a block that may be linked, and no one-to-one choice of such pairs is better in total."""
    from kinweave.functions import text
    from kinweave.sources import adapters

    rows = [r.asDict() for r in adapters.places(spark, tiny).withColumn("block", text.block_key("geo", 16)).collect()]
    sides = [[r for r in rows if r["data_source"] == s] for s in ("http://sws.geonames.org/", "http://dbpedia.org/")]
    pairs = {}
    for r, s in itertools.product(*sides):
        name, place = scalar.geo_string_sim(r["label"], s["label"]), scalar.place_sim(r, s)
        sim = name if place is None or name is None else round((place + name) / 2, 10)
        if r["block"] == s["block"] and sim is not None and sim >= 0.7:
            pairs[r["id"], s["id"]] = sim
    got = registry.QUERIES["main_source_places"](spark, tiny).collect()
    members = [tuple(map(int, r["clustered"].split(","))) for r in got]
    assert sorted(x for m in members for x in m) == sorted(r["id"] for side in sides for r in side)
    linked = [pairs.get(m, pairs.get(m[::-1])) for m in members if len(m) == 2]
    assert all(x is not None for x in linked) and all(len(m) < 3 for m in members)
    assert abs(sum(linked) - plain_assignment([(a, b, s) for (a, b), s in pairs.items()])) < 1e-9


@pytest.mark.parametrize("domain", ["music", "nc"])
def test_merge_by_kinds_is_the_plain_one(domain):
    """a block merged without a list of pairs, against the plain iteration over all of them."""
    rng = random.Random(27)
    for _ in range(150):
        records = [dict(r, block="", year=1 + r["year"], length=1 + r["length"]) for r in random_clusters(rng, rng.randrange(2, 30))]
        least = rng.choice([0.4, 0.6, 0.8])
        kinds = [tuple(r[c] for c in merging.SEEN[domain]) for r in records]
        got = merging.merge_looks(domain, [r["sources_int"] for r in records], [1] * len(records), kinds, [r["number"] for r in records], least, 4)
        got = sorted((min(m), tuple(sorted(m)), sum(records[i]["sources_int"] for i in m), records[h]["label"]) for m, h in got)
        assert got == plain_blocks(domain, records, least, 4, lambda r: "")
