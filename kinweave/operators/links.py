"""Links between entities: similarities, cleaning, and the filters that keep a cluster free of two rows of one source."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import bits, scalar, similarity, text, types
from ..session import Appended, durable, map_rows, ship
from . import blocking
from .components import with_components


def with_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends as structs s and t; edges that lack an end go."""
    row = F.struct(*vertices.columns)
    both = edges.join(vertices.select(F.col("id").alias("src"), row.alias("s")), "src").join(vertices.select(F.col("id").alias("dst"), row.alias("t")), "dst")
    return both.select(*edges.columns, "s", "t")


def with_value(edges: DataFrame, vertices: DataFrame, end: str, column: str, name: str) -> DataFrame:
    """Edges with a column of the vertex at one end (src or dst), under a name; edges without that vertex go."""
    return edges.join(vertices.select(F.col("id").alias(end), F.col(column).alias(name)), end).select(*edges.columns, name)


def between_sources(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct edges whose ends come from different sources."""
    narrow = vertices.select("id", "data_source")
    return with_ends(edges, narrow).where("s.data_source <> t.data_source").drop("s", "t").dropDuplicates(["src", "dst"])


def with_known_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct edges of which both ends exist."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns).dropDuplicates(["src", "dst"])


def linked(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with an edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return vertices.join(ends, "id", "left_semi")


def of_equal_types(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct edges whose ends share a shaded type, or of which one has none."""
    narrow = vertices.select("id", types.shade(F.col("types")).alias("kinds"), similarity.typed(F.col("types")).alias("typed"))
    kept = with_ends(edges, narrow).where("NOT s.typed OR NOT t.typed OR arrays_overlap(s.kinds, t.kinds)")
    return kept.drop("s", "t").dropDuplicates(["src", "dst"])


def with_similarity(edges: DataFrame, vertices: DataFrame, domain: str, metric: str = "ct", least: float | None = 0.6) -> DataFrame:
    """Edges with their similarities and the mean agg_sim of those that are there; only those above `least`."""
    ends = with_ends(edges.select("src", "dst"), vertices)
    sims = similarity.edge_sims(domain, lambda c: F.col(f"s.{c}"), lambda c: F.col(f"t.{c}"), metric)
    out = ends.select("src", "dst", *(v.alias(k) for k, v in sims.items()))
    out = out.withColumn("agg_sim", similarity.mean(*(F.col(k) for k in sims)))
    return out if least is None else out.where(F.col("agg_sim") > least)


def acceptable(least: float) -> Column:
    """Two of three similarities and a high mean, or a high label similarity that nothing contradicts."""
    label, place, kind, mean = (F.col(c) for c in ("sim_label", "sim_distance", "sim_type", "agg_sim"))
    there = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (label, place, kind)), F.lit(0))
    fine = lambda x: x.isNull() | (x > 0.7)
    return F.coalesce((mean > least) & (there >= 2), F.lit(False)) | F.coalesce((label > 0.8) & fine(place) & fine(kind), F.lit(False))


#: How many times fewer the pairs of values must be than those of rows, for values to be compared in their place.
FEW_VALUES = 4

#: Edges of a component that one task filters; larger components are filtered by rounds of joins.
TASK_EDGES = 50_000


def greedy_disjoint(edges: list[tuple], masks: dict[int, int]) -> list[tuple]:
    """Edges (src, dst, ...) in their order, each kept if the clusters of its ends share no source; these become one."""
    parent, mask = {v: v for v in masks}, dict(masks)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for e in edges:
        a, b = root(e[0]), root(e[1])
        if a != b and mask[a] & mask[b] == 0:
            parent[max(a, b)] = min(a, b)
            mask[min(a, b)] = mask[a] | mask[b]
            out.append(e)
    return out


def _filter_component(row: dict) -> list[tuple]:
    edges = sorted(((e["src"], e["dst"], e["agg_sim"]) for e in row["e"]), key=lambda e: (-e[2], e[0], e[1]))
    masks = {e["src"]: e["s_mask"] for e in row["e"]} | {e["dst"]: e["t_mask"] for e in row["e"]}
    return greedy_disjoint(edges, masks)


def _filtered(ends: DataFrame) -> DataFrame:
    whole = ends.groupBy("cc_id").agg(F.collect_list(F.struct("src", "dst", "agg_sim", "s_mask", "t_mask")).alias("e"))
    return map_rows(whole.select("e"), _filter_component, "src long, dst long, agg_sim double")


def _by_rounds(edges: DataFrame) -> DataFrame:
    """The same without collecting a component: an edge that is the first in order at both its clusters is decided at once."""
    nodes = edges.select(F.col("src").alias("id"), F.col("s_mask").alias("mask")).unionByName(edges.select(F.col("dst").alias("id"), F.col("t_mask").alias("mask"))).groupBy("id").agg(F.bit_or("mask").alias("mask"))
    clusters = durable(nodes.select("id", F.col("id").alias("c"), "mask"))
    left, out = durable(edges.select("src", "dst", "agg_sim")), Appended(edges.sparkSession)
    while left.head() is not None:
        of = clusters.select("id", "c", "mask")
        ends = left.join(of.select(F.col("id").alias("src"), F.col("c").alias("a"), F.col("mask").alias("am")), "src").join(of.select(F.col("id").alias("dst"), F.col("c").alias("b"), F.col("mask").alias("bm")), "dst")
        ends = durable(ends.where("a <> b AND (am & bm) = 0"))  # what fails now fails for good, as masks only grow
        order = F.struct((-F.col("agg_sim")).alias("o"), "src", "dst")
        at = ends.select(F.explode(F.array("a", "b")).alias("c"), order.alias("e"))
        best = at.groupBy("c").agg(F.min("e").alias("e"))
        twice = best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.src", "e.dst")
        chosen = durable(ends.join(twice, ["src", "dst"], "left_semi"))
        kept = out.add(chosen.select("src", "dst", "agg_sim"))
        joined = chosen.select(F.explode(F.array("a", "b")).alias("c"), F.least("a", "b").alias("n"), F.col("am").bitwiseOR(F.col("bm")).alias("m"))
        clusters = durable(clusters.join(joined, "c", "left").select("id", F.coalesce("n", "c").alias("c"), F.coalesce("m", "mask").alias("mask")))
        left = durable(ends.select("src", "dst", "agg_sim").join(kept.select("src", "dst"), ["src", "dst"], "left_anti"))
    return out.all(edges.select("src", "dst", "agg_sim").schema)


def filter_basic(edges: DataFrame, vertices: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """src, dst, agg_sim of the links that stay when, best first, no cluster may get two rows of one source.

    edges (src, dst, agg_sim), vertices (id, sources_int).
    """
    narrow = vertices.select("id", "sources_int")
    ends = with_ends(edges.select("src", "dst", "agg_sim"), narrow).select("src", "dst", "agg_sim", F.col("s.sources_int").alias("s_mask"), F.col("t.sources_int").alias("t_mask"))
    known = with_components(narrow.select("id"), edges.select("src", "dst"))
    ends = durable(ends.join(known.select(F.col("id").alias("src"), "cc_id"), "src"))
    sizes = ends.groupBy("cc_id").agg(F.count("*").alias("n"))
    large = durable(sizes.where(F.col("n") > task_edges).select("cc_id"))
    if large.head() is None:
        return _filtered(ends)
    small = _filtered(ends.join(large, "cc_id", "left_anti"))
    return small.unionByName(_by_rounds(ends.join(large, "cc_id", "left_semi")))


#: Rows of a block that filter_blocks() takes, with at most so many pairs of looks.
TASK_ROWS, TASK_LOOKS = 1_000_000, 2_000_000


def greedy_same(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """greedy_disjoint() of the links between rows (id, mask, source) that all look the same: its links (src, dst), and id, mask of the row's cluster, cluster.

    A row takes the next larger ones that it may have. Then no larger one may be had by its cluster, so it's done. Where rows
    of one source have masks that don't meet, this doesn't hold, and all rows come back as they were.
    """
    rows = sorted(rows)
    queues: dict[tuple, deque] = {}
    for i, mask, source in rows:
        queues.setdefault((mask, source), deque()).append(i)
    if any(k[1] == n[1] and k[0] & n[0] == 0 for k in queues for n in queues):
        return [], [(i, mask, i) for i, mask, _ in rows]
    out, done = [], []
    for i, mask, source in rows:
        own = queues[mask, source]
        if not own or own[0] != i:
            continue  # it went to a smaller one
        own.popleft()
        members = [i]
        while True:
            kind = min((k for k, q in queues.items() if q and k[0] & mask == 0 and k[1] != source), key=lambda k: queues[k][0], default=None)
            if kind is None:
                break
            mask |= kind[0]
            members.append(queues[kind].popleft())
        out += [(i, j) for j in members[1:]]
        done += [(j, mask, i) for j in members]
    return out, done


def _greedy_levels(ids: np.ndarray, mask: np.ndarray, source: np.ndarray, look: np.ndarray, cluster: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> list[tuple]:
    """greedy_looks() over arrays: rows that may be in clusters already, whose masks are those of the clusters."""
    order = np.argsort(ids, kind="stable")
    ids, mask, source, look, cluster = (x[order] for x in (ids, mask.astype(np.int64), source, look, cluster))
    names, look = np.unique(look, return_inverse=True)
    there = np.isin(a, names) & np.isin(b, names)
    a, b, sim = np.searchsorted(names, a[there]), np.searchsorted(names, b[there]), sim[there]
    members: dict[int, list[int]] = {}
    for i, c in enumerate(cluster.tolist()):
        members.setdefault(c, []).append(i)
    members = [members[c] for c in cluster.tolist()]
    alive = np.split(np.argsort(look, kind="stable"), np.cumsum(np.bincount(look, minlength=len(names)))[:-1])
    full, out = np.bitwise_or.reduce(mask) if len(mask) else 0, []
    # rows of each look by mask: two looks are gone through only where two of their masks may join
    number = {m: k for k, m in enumerate(np.unique(mask).tolist())}
    of = np.searchsorted(np.array(sorted(number), np.int64), mask)
    held = np.zeros((len(names), max(8, 2 * len(number))), np.int32)
    np.add.at(held, (look, of), 1)

    def joins() -> np.ndarray:
        masks = np.full(held.shape[1], -1, np.int64)
        masks[: len(number)] = list(number)
        return ((masks[:, None] & masks[None, :]) == 0).astype(np.float32)

    fits = joins()

    def join(i: int, j: int) -> None:
        nonlocal held, fits
        both, new = members[i] + members[j], int(mask[i] | mask[j])
        if new not in number:
            number[new] = len(number)
            if len(number) > held.shape[1]:
                held = np.concatenate([held, np.zeros_like(held)], axis=1)
            fits = joins()
        k = number[new]
        for r in both:
            held[look[r], of[r]] -= 1
            held[look[r], k] += 1
            mask[r], of[r], members[r] = new, k, both

    order = np.argsort(-sim, kind="stable")
    a, b, sim = a[order], b[order], sim[order]
    cuts = np.flatnonzero(np.diff(sim)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sim)], strict=True):
        if begin == end:
            continue
        x, y = a[begin:end], b[begin:end]
        x, y = np.concatenate([x, y[x != y]]), np.concatenate([y, x[x != y]])
        may = np.concatenate([(((held[y[c : c + 50_000]] > 0).astype(np.float32) @ fits > 0) & (held[x[c : c + 50_000]] > 0)).any(axis=1) for c in range(0, len(x), 50_000)])
        x, y = x[may], y[may]
        if not len(x):
            continue
        near, rows, level = {}, [], float(sim[begin])
        for v in np.unique(x).tolist():
            others = np.unique(y[x == v]).tolist()
            for w in {v, *others}:
                alive[w] = alive[w][mask[alive[w]] != full]
            near[v] = np.sort(np.concatenate([alive[w] for w in others]))
            rows.append(alive[v][((held[others] > 0).any(axis=0).astype(np.float32) @ fits > 0)[of[alive[v]]]])
        for i in np.sort(np.concatenate(rows)).tolist():
            all_, step = near[look[i]], 256
            at = int(np.searchsorted(all_, i, "right"))
            while at < len(all_) and mask[i] != full:
                some = all_[at : at + step]
                hit = np.flatnonzero(((mask[some] & mask[i]) == 0) & (source[some] != source[i]))
                if not len(hit):
                    at, step = at + step, 2 * step
                    continue
                j = int(some[hit[0]])
                out.append((int(ids[i]), int(ids[j]), level))
                join(i, j)
                at += int(hit[0]) + 1
    return out


def greedy_looks(rows: list[tuple], sims: list[tuple]) -> list[tuple]:
    """greedy_disjoint() of all links between rows (id, mask, source, look) in the order of similarities, then ids, that looks (a, b, sim) give, without a list of links.

    Rows of equal source make no link. A row that fails a partner fails it for good, as masks only grow.
    """
    ids, mask, source, look = (np.array(c) for c in zip(*rows, strict=True))
    a, b, sim = (np.array(c) for c in zip(*sims, strict=True)) if sims else (np.array([], k) for k in (np.int64, np.int64, float))
    return _greedy_levels(ids, mask, np.unique(source.astype(str), return_inverse=True)[1], look, ids, a, b, sim)


def _links_of_looks(rows: DataFrame, key: str) -> DataFrame:
    """Links (src, dst) of rows (key, id, sources_int, data_source, look, full) that look the same, and the rows that they leave in clusters with room, with cluster and its mask."""
    kind = dict(rows.dtypes)[key]
    names = ["src", "dst", key, "id", "sources_int", "data_source", "look", "cluster"]
    schema = f"src long, dst long, `{key}` {kind}, id long, sources_int long, data_source string, look long, cluster long"
    kinds = to_arrow_schema(_parse_datatype_string(schema))
    ship(rows.sparkSession)

    def run(batches):
        def solved(some: list[tuple]) -> list[tuple]:
            of, full, look = {r[1]: r[3] for r in some}, some[0][5], some[0][4]
            out, done = greedy_same([(i, m, s) for _, i, m, s, _, _ in some])
            block = some[0][0]
            return [(a, b, *[None] * 6) for a, b in out] + [(None, None, block, i, m, of[i], look, c) for i, m, c in done if m != full]

        def arrow(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

        some, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if some and row[4] != some[0][4]:
                    out += solved(some)
                    some = []
                    if len(out) > 20_000:
                        yield arrow(out)
                        out = []
                some.append(row)
        if some:
            out += solved(some)
        if out:
            yield arrow(out)

    dealt = blocking._spread(rows, ["look"]).sortWithinPartitions("look", "id").select(key, "id", F.col("sources_int").cast("long"), "data_source", "look", "full")
    return durable(dealt.mapInArrow(run, schema).select(*names))


def gram_sims(strings: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, sim: similarity.string_sim() of simplified strings with each other and themselves, i <= j, above `least`: counts of a trigram meet those of the strings that have it."""
    grams: dict[str, list[tuple[int, int]]] = {}
    for i, x in enumerate(strings):
        for g, n in scalar._grams(x).items():
            grams.setdefault(g, []).append((i, n))
    dot = np.zeros((len(strings), len(strings)))
    for held in grams.values():
        at, n = np.array(held).T
        dot[np.ix_(at, at)] += np.outer(n, n)
    norm = dot.diagonal()
    norm = np.where(norm == 0, 1.0, norm)
    sim = dot / np.sqrt(norm[:, None] * norm[None, :])
    names = np.unique(np.array(strings, object), return_inverse=True)[1]
    i, j = np.nonzero(np.triu((sim > least - 1e-5) | (names[:, None] == names[None, :])))
    sim, same = sim[i, j], names[i] == names[j]
    out = np.round(sim, 6)
    for k in np.flatnonzero(np.abs(sim * 1e6 % 1 - 0.5) < 1e-4).tolist():  # halves go up, as in Spark
        out[k] = float(Decimal(repr(float(sim[k]))).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    out[same] = 1.0
    kept = out > least
    return i[kept], j[kept], out[kept]


def _gram_links(heads: DataFrame, key: str, least: float) -> DataFrame:
    """src, dst, agg_sim, key: the pairs of rows (key, id, x) of a block, each with itself too, whose strings are more similar than `least`, src <= dst."""
    ship(heads.sparkSession)
    schema = f"src long, dst long, agg_sim double, `{key}` {dict(heads.dtypes)[key]}"
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def score(some: pa.Table) -> pa.Table:
        some = some.sort_by("id")
        ids = some.column("id").to_numpy()
        i, j, sim = gram_sims(some.column("x").to_pylist(), least)
        block = pa.repeat(some.column(key)[0], len(i))
        return pa.Table.from_arrays([pa.array(ids[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(sim), block], schema=kinds)

    return heads.where("x IS NOT NULL").select(key, F.col("id").cast("long"), "x").groupBy(key).applyInArrow(score, schema)


def filter_blocks(vertices: DataFrame, key: str, looks: tuple[str, ...], domain: str, metric: str, least: float) -> tuple[DataFrame, DataFrame]:
    """filter_basic() of the links above `least` between all rows of a block from different sources, without these links; and the blocks that are too large for it.

    vertices: id, sources_int, data_source, key and `looks`, all that the similarity sees: rows of a block that look the same are scored once.
    Rows that look the same and like no other row have similarity 1, the highest, only with each other. So these come first, each look by
    itself, and only rows in clusters with room are left for their block's task.
    """
    of = vertices.where(F.col(key).isNotNull() & F.col("data_source").isNotNull() & (F.col("sources_int") != 0))
    rows = durable(of.withColumn("look", F.min("id").over(Window.partitionBy(key, *looks))))
    heads = rows.where("id = look")
    counts = durable(rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.when(F.col("id") == F.col("look"), 1).otherwise(0)).alias("h"), F.bit_or("sources_int").cast("long").alias("full")))
    large = durable(counts.where((F.col("n") > TASK_ROWS) | (F.col("h") * (F.col("h") + 1) / 2 > TASK_LOOKS)).select(key))
    small = heads.join(large, key, "left_anti")
    if domain == "music" and metric == "ct" and least >= 0:
        scored = durable(_gram_links(small.select(key, "id", text.simplify(text.sane("ata")).alias("x")), key, least))
    else:
        each = blocking.pairs(small.select("id", key), key).select("src", "dst").unionByName(small.select(F.col("id").alias("src"), F.col("id").alias("dst")))
        seen = heads.select("id", *looks)
        scored = durable(with_similarity(each, seen, domain, metric, least).select("src", "dst", "agg_sim").join(heads.select(F.col("id").alias("src"), key), "src"))
    equal = scored.where("agg_sim = 1")
    others = equal.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("look"))
    alone = equal.where("src = dst").select(F.col("src").alias("look")).join(others, "look", "left_anti").withColumn("alone", F.lit(True))
    narrow = rows.join(large, key, "left_anti").select(key, "id", "sources_int", "data_source", "look").join(alone, "look", "left")
    same = _links_of_looks(narrow.where("alone").join(counts.select(key, "full"), key), key)
    members = same.where("id IS NOT NULL").drop("src", "dst")
    members = members.unionByName(narrow.where("alone IS NULL").select(key, "id", F.col("sources_int").cast("long"), "data_source", "look", F.col("id").alias("cluster")))
    kinds = to_arrow_schema(_parse_datatype_string("src long, dst long, agg_sim double"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        n = lambda t, c: t.column(c).to_numpy()
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        source = left.column("data_source").combine_chunks().dictionary_encode().indices.to_numpy()
        found = _greedy_levels(*(n(left, c) for c in ("id", "sources_int")), source, *(n(left, c) for c in ("look", "cluster")), *(n(right, c) for c in ("src", "dst", "agg_sim")))
        return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds) if found else kinds.empty_table()

    ship(vertices.sparkSession)
    sims = scored.select(key, "src", "dst", "agg_sim")
    more = members.groupBy(key).cogroup(sims.groupBy(key)).applyInArrow(solve, "src long, dst long, agg_sim double")
    return same.where("src IS NOT NULL").select("src", "dst", F.lit(1.0).alias("agg_sim")).unionByName(more), large


def filter_clustering(edges: DataFrame, vertices: DataFrame, reference_compat: bool = False, known: DataFrame | None = None) -> DataFrame:
    """src, dst, agg_sim without the weaker rows of a source in a component.

    A vertex with a neighbour of its own source is a candidate; of the candidates of a component and source the one with the
    highest mean similarity (then the smallest id) stays, the others lose their links. With reference_compat all
    candidates lose them, wherever they are. known: (id, data_source, cc_id), where the components of these edges are known.
    """
    rows = with_components(vertices.select("id", "data_source"), edges) if known is None else known
    ends = with_ends(edges.select("src", "dst", "agg_sim"), rows)
    both = ends.select(F.col("s").alias("v"), F.col("t").alias("n"), "agg_sim").unionByName(ends.select(F.col("t").alias("v"), F.col("s").alias("n"), "agg_sim"))
    each = both.groupBy(F.col("v.id").alias("id")).agg(F.first("v.cc_id").alias("cc_id"), F.first("v.data_source").alias("data_source"), F.avg("agg_sim").alias("m"), F.bool_or(F.col("v.data_source") == F.col("n.data_source")).alias("twice")).where("twice")
    place = F.row_number().over(Window.partitionBy("cc_id", "data_source").orderBy(F.desc("m"), "id"))
    lost = each if reference_compat else each.withColumn("p", place).where("p > 1")
    out = edges.select("src", "dst", "agg_sim")
    for end in ("src", "dst"):
        out = out.join(lost.select(F.col("id").alias(end)), end, "left_anti")
    return out.select("src", "dst", "agg_sim")


def max_both(pairs: DataFrame, sim: str = "sim") -> DataFrame:
    """Pairs that are the best of both their ends; ties go to the smaller partner."""
    best = lambda end, other: F.row_number().over(Window.partitionBy(end).orderBy(F.desc(sim), other))
    ranked = pairs.withColumn("_a", best("src", "dst")).withColumn("_b", best("dst", "src"))
    return ranked.where("_a = 1 AND _b = 1").drop("_a", "_b")


def one_to_many(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """src, data_source, n: vertices with several links into one source, either way."""
    ends = with_ends(edges, vertices.select("id", "data_source"))
    both = ends.select(F.col("src").alias("id"), F.col("t.data_source").alias("to_source")).unionByName(ends.select(F.col("dst").alias("id"), F.col("s.data_source").alias("to_source")))
    return both.groupBy("id", "to_source").agg(F.count("*").alias("n")).where("n > 1")


def overfull_components(vertices: DataFrame) -> DataFrame:
    """cc_id, n, sources of components with more rows than sources."""
    return vertices.groupBy("cc_id").agg(F.count("*").alias("n"), F.count_distinct("data_source").alias("sources")).where("sources < n")


#: Steps of clustering in which pairs with a common source are left out; in all others they may meet.
EXCLUSIVE_STEPS = ("source_addition", "cluster_addition")


def without_overlap(pairs: DataFrame, vertices: DataFrame, step: str) -> DataFrame:
    """Pairs (s.data_sources, t.data_sources) that share no source and have together at most as many as occur at all, in the steps that ask for it."""
    if step not in EXCLUSIVE_STEPS:
        return pairs
    total = vertices.select(F.explode("data_sources").alias("x")).agg(F.count_distinct("x").alias("_total"))  # one row
    a, b = F.col("s.data_sources"), F.col("t.data_sources")
    return pairs.join(F.broadcast(total)).where(source_overlap(a, b) & (F.size(a) + F.size(b) <= F.col("_total"))).drop("_total")


def scored_pairs(pairs: DataFrame, domain: str, kind: str, metric: str = "ct", least: float | None = None) -> DataFrame:
    """src, dst, similarities and their mean `sim` of pairs (src, dst, s, t); kind: edge, merge or addition. Only merge and addition keep to a threshold."""
    s, t = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"t.{c}"))
    if kind == "addition":
        out = pairs.select("src", "dst", similarity.addition_sim(domain, s, t, metric).alias("sim"))
    elif kind in ("edge", "merge"):
        sims = similarity.edge_sims(domain, s, t, metric) if kind == "edge" else similarity.merge_sims(domain, s, t, metric)
        parts = pairs.select("src", "dst", *(v.alias(k) for k, v in sims.items()))
        out = parts.withColumn("sim", similarity.mean(*(F.col(k) for k in sims)))
    else:
        raise ValueError(f"no similarity of kind {kind!r}")
    return out if least is None or kind == "edge" else out.where(F.col("sim") >= least)


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """src, dst: every row of one side linked to every row of the other with the same key."""
    return blocking.cross_pairs(left.select("id", key), right.select("id", key), key).select("src", "dst")


def disjoint_pairs(rows: DataFrame, most: int) -> DataFrame:
    """src, dst of every two rows at all with disjoint sources, at most `most` together: by definition the square of a small table."""
    return blocking.pairs(rows.select("id", "sources_int", F.lit(0).alias("block")), "block", blocking.disjoint(most)).select("src", "dst")


def component_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """cc_id, src, dst: links in both directions, each once, of the vertices (id, cc_id)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return members.select(F.col("id").alias("src"), "cc_id").join(both, "src").select("cc_id", "src", "dst")


def source_overlap(a: Column, b: Column, most: int | None = None) -> Column:
    """Whether two arrays of sources are disjoint and, if given, at most `most` together."""
    out = ~F.arrays_overlap(a, b)
    return out & (F.size(a) + F.size(b) <= most) if most else out


def with_value_sims(pairs: DataFrame, rows: DataFrame, key: str, sims: dict[str, Callable[[Column, Column], Column]]) -> tuple[DataFrame, dict[str, Column]]:
    """pairs (key, s, t) of rows of a block, with the similarities of columns that have few values in a block; and these, by name of column.

    sims: the similarity of two values, by column. Two values of a block are compared once, whatever rows have them. A column
    whose values make nearly as many pairs as the rows stays out, for the caller to compare pair by pair.
    """
    cells = lambda n: F.sum(n.cast("double") * n)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), *(F.count_distinct(c).alias(c) for c in sims))
    size = counts.agg(cells(F.col("_n")).alias("_n"), *(cells(F.col(c)).alias(c) for c in sims)).head()
    known = {}
    for c, sim in sims.items():
        if (size[c] or 0) * FEW_VALUES > (size["_n"] or 0):
            continue
        values = rows.select(key, F.col(c).alias("id")).where(F.col(key).isNotNull() & F.col("id").isNotNull()).distinct()
        found = durable(blocking.pairs(values, key).select(F.col(key).alias("_k"), F.col("src").alias("_a"), F.col("dst").alias("_b"), sim(F.col("src"), F.col("dst")).alias(f"_sim_{c}")))
        same = values.select(F.col(key).alias("_k"), F.col("id").alias("_a"), F.col("id").alias("_b"), sim(F.col("id"), F.col("id")).alias(f"_sim_{c}"))
        table = durable(found.unionByName(found.select("_k", F.col("_b").alias("_a"), F.col("_a").alias("_b"), f"_sim_{c}")).unionByName(same))
        # a row without a value has no similarity, as there is none in the table
        pairs = pairs.join(table, (F.col(key) == F.col("_k")) & (F.col(f"s.{c}") == F.col("_a")) & (F.col(f"t.{c}") == F.col("_b")), "left").drop("_k", "_a", "_b")
        known[c] = F.col(f"_sim_{c}")
    return pairs, known


def support(edges: DataFrame, least: int) -> DataFrame:
    """src, dst, n of the pairs that occur at least so often."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def masked(vertices: DataFrame, table: dict[str, int]) -> DataFrame:
    """Vertices with sources_int by a dictionary."""
    return vertices.withColumn("sources_int", bits.encode_one(F.col("data_source"), table))
