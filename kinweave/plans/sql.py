"""Pieces of DuckDB SQL for the checks of the queries."""

from __future__ import annotations


def simple(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g'))"


def grams(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN list_transform(range(1, length({x}) + 3), lambda i: substr('##' || {x} || '##', CAST(i AS BIGINT), 3)) ELSE [] END"


def dot(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_distinct({x}), lambda g: len(list_filter({x}, lambda z: z = g)) * len(list_filter({y}, lambda z: z = g))))"


def similar_labels(labels: str, x: str = "label") -> str:
    """a, b, sim of every two of a few distinct strings (one column x)."""
    return f"""(SELECT a, b, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE {dot("x", "y")} / sqrt(({dot("x", "x")} * {dot("y", "y")})::DOUBLE) END, 6) AS sim
  FROM (SELECT p.l AS a, q.l AS b, {grams("p.s")} AS x, {grams("q.s")} AS y FROM (SELECT {x} AS l, {simple(x)} AS s FROM {labels}) p, (SELECT {x} AS l, {simple(x)} AS s FROM {labels}) q))"""


def music_key(x: str, n: int = 4) -> str:
    low = f"lower({x})"
    rest = f"CASE WHEN starts_with({low}, 'the') AND length({low}) > 3 THEN trim(substr({low}, 5)) ELSE {low} END"
    return f"CASE WHEN substr({rest}, 1, {n}) = '' THEN substr({low}, 1, {n}) ELSE substr({rest}, 1, {n}) END"


def geo_key(x: str, n: int = 3) -> str:
    return f"rpad(regexp_replace(lower(rpad({x}, {n}, '#')), '[^a-zA-Z0-9#]+', '#', 'g'), {n}, '#')"


def md5_little(x: str) -> str:
    """First eight bytes of MD5 in reverse, as a signed long."""
    digest = "".join(f" || substr(md5({x}), {i}, 2)" for i in range(15, 0, -2)).removeprefix(" || ")
    wide = f"CAST('0x' || {digest} AS UBIGINT)"
    return f"CAST(CASE WHEN {wide} >= 9223372036854775808 THEN CAST({wide} AS HUGEINT) - 18446744073709551616 ELSE {wide} END AS BIGINT)"


def mean(sims: list[str], places: int = 10) -> str:
    n = " + ".join(f"CASE WHEN {s} IS NOT NULL THEN 1 ELSE 0 END" for s in sims)
    total = " + ".join(f"coalesce({s}, 0.0)" for s in sims)
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE round(({total})::DOUBLE / ({n}), {places}) END"


def place_sim(a: str = "s", b: str = "t") -> str:
    h = f"pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)"
    d = f"(2 * 6371000 * atan2(sqrt({h}), sqrt(1 - ({h}))))"
    return f"CASE WHEN {d} >= 150000 THEN 0.0 ELSE round(1 - {d} / 150000, 6) END"


def components(nodes: str, edges: str) -> str:
    """node, component over edges (u, v): a recursive walk, for small graphs."""
    return f"""WITH RECURSIVE both_ways AS (SELECT u, v FROM {edges} UNION SELECT v, u FROM {edges}),
walk(node, seen) AS (SELECT node, node FROM {nodes} UNION SELECT w.node, b.v FROM walk w JOIN both_ways b ON b.u = w.seen)
SELECT node, min(seen) AS component FROM walk GROUP BY node"""
