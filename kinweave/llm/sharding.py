"""Operator 7, sharding by histogram sort, law `bytes`: shards of nearly equal size, groups of equal texts kept together.

Rows are ordered by (hash of the text, key), so equal texts lie side by side. Splitter i stands before the first row that has
i / shards of all bytes before it; where that is inside a group of equal texts of at most 1 / TOLERANCE of a shard's share, it
moves to the group's nearer edge (the lower one on ties). Only a larger group is parted. So a shard is off its share by one
row or such a group at each end at most.

The splitters are found without sorting: of a few candidate boundaries for each, every partition counts the exact bytes and
rows below; the sums come to the driver (some hundred numbers), the interval that holds the splitter is cut again, and so on
until one row is left between its ends. Then rows move once, to their shard. Inside a large shard, further boundaries cut runs
of about RUN_ROWS rows: places at even distances, counted exactly, and cut again where a run is still too large. The counts
below them give each run its first slot, so no task ever numbers a whole shard, and the driver holds a number for each run.

Defined cases: a null text counts as empty, of size 8; a null key sorts first; rows equal in text and key are never split
and are numbered in any order; fewer rows than shards leave shards empty; a very long text is a row like any other, of its
size; an empty table gives an empty result; clashing column names of the input are kept out by selecting key and text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, durable

#: Candidate boundaries for a splitter in a round.
PROBES = 31
#: Rows of a run that one task numbers, about.
RUN_ROWS = 1_000_000
#: Groups of equal texts of up to this part of a shard's share aren't parted.
TOLERANCE = 100
OVERHEAD = 8
LEAST = -(2**63)


def _places(h: np.ndarray, d: np.ndarray, ph: np.ndarray, pd: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (ph, pd) are at or below each (h, d)."""
    lo, hi = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = lo.copy()
    same = np.nonzero(hi > lo)[0]
    if len(same):
        for a in np.unique(lo[same]):
            rows = same[lo[same] == a]
            b = hi[rows[0]]
            out[rows] = a + np.searchsorted(pd[a:b], d[rows], "right")
    return out


def sized(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32 and the sort key (h, d) of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key).cast("long").alias("key"),
        (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(t.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long")).alias("d"),
    )


def _counted(rows: DataFrame, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows below each of the sorted boundaries."""
    ph, pd = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, d, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        at = _places(h, d, ph, pd)
        some, back = np.unique(at, return_inverse=True)
        sizes = np.zeros(len(some), np.int64)
        np.add.at(sizes, back, size)
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(sizes), pa.array(np.bincount(back).astype(np.int64))], names=["at", "size", "n"])

    got = arrow_rows(rows.select("h", "d", "size"), run, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, n = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in got:
        size[r["at"]], n[r["at"]] = r["size"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


def splitters(rows: DataFrame, targets: list[int], total: tuple[int, int], span: tuple[int, int]) -> list[tuple[tuple[int, int], int, int]]:
    """For each target the smallest boundary with at least so many bytes below it, and the bytes and rows below. span: smallest and largest d."""
    base, width = span[0], span[1] - span[0] + 1
    pair = lambda k: (k // width, base + k % width)
    # of each target: the interval of boundaries, and bytes and rows below its ends
    state = [[0, (1 << 60) * width, 0, total[0], 0, total[1]] for _ in targets]
    while open_ := [i for i, s in enumerate(state) if s[1] - s[0] > 1 and s[5] - s[4] > 1]:
        probes = sorted({s[0] + (s[1] - s[0]) * j // (PROBES + 1) for i in open_ for s in [state[i]] for j in range(1, PROBES + 1)})
        size, n = _counted(rows, [pair(p) for p in probes])
        for i, at in zip(open_, np.searchsorted(size, [targets[i] for i in open_]).tolist(), strict=True):
            s = state[i]
            if at < len(probes) and probes[at] < s[1]:
                s[1], s[3], s[5] = probes[at], int(size[at]), int(n[at])
            if at and probes[at - 1] > s[0]:
                s[0], s[2], s[4] = probes[at - 1], int(size[at - 1]), int(n[at - 1])
    return [(pair(s[1]), s[3], s[5]) for s in state]


def _at_edges(rows: DataFrame, found: list[tuple[tuple[int, int], int, int]], targets: list[int], most: int) -> list[tuple[tuple[int, int], int]]:
    """Boundaries and the rows below them, moved to the nearer edge of groups of equal texts of at most `most` bytes."""
    # a boundary lies behind the last row below it, whose hash is that of the boundary or, where none of that is below, a smaller one
    edges = sorted({(h + k, LEAST) for (h, _), _, _ in found for k in (0, 1)})
    size, n = _counted(rows, edges)
    below = {e[0]: (int(a), int(b)) for e, a, b in zip(edges, size, n, strict=True)}
    out = []
    for ((h, d), size_, n_), target in zip(found, targets, strict=True):
        (low, low_n), (high, high_n) = below[h], below[h + 1]
        if low < size_ < high and high - low <= most:
            out.append(((h, LEAST), low_n) if target - low <= high - target else ((h + 1, LEAST), high_n))
        else:
            out.append(((h, d), n_))
    return out


def _runs(rows: DataFrame, cuts: list[tuple[tuple[int, int], int]], total: int, span: tuple[int, int]) -> list[tuple[tuple[int, int], int]]:
    """Further boundaries, with the rows below them, that leave about RUN_ROWS rows between two neighbours or what can't be parted."""
    base, width = span[0], span[1] - span[0] + 1
    line = lambda b: b[0] * width + max(0, b[1] - base)
    known = {0: 0, (1 << 60) * width: total} | {line(b): n for b, n in cuts}
    fixed = set(known)
    while True:
        ends, probes = sorted(known), set()
        for a, b in zip(ends, ends[1:], strict=False):
            if known[b] - known[a] > RUN_ROWS:
                # twice as many places as runs, and many where all rows may lie in a small part of the interval
                pieces = min(b - a, max(PROBES + 1, 2 * (known[b] - known[a]) // RUN_ROWS))
                probes |= {a + (b - a) * j // pieces for j in range(1, pieces)}
        if not probes:
            break
        probes = sorted(probes)
        _, n = _counted(rows, [(p // width, base + p % width) for p in probes])
        known |= zip(probes, n.tolist(), strict=True)
    # of all places, only those that keep runs small
    out, begin, ends = [], 0, sorted(known)
    for at, after in zip(ends[1:], ends[2:], strict=False):
        if at in fixed:
            begin = known[at]
        elif known[after] - begin > RUN_ROWS:
            out.append(((at // width, base + at % width), known[at]))
            begin = known[at]
    return out


def shard(df: DataFrame, shards: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of each row."""
    rows = durable(sized(df, text, key))
    bytes_, n, lo, hi = rows.select(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.min("d"), F.max("d")).head()
    targets = [-(-bytes_ * i // shards) for i in range(1, shards)]
    cuts = _at_edges(rows, splitters(rows, targets, (bytes_, n), (lo, hi)), targets, bytes_ // (shards * TOLERANCE)) if n and targets else []
    bounds = [(b, below, i + 1) for i, (b, below) in enumerate(cuts)]
    bounds += [(b, below, None) for b, below in (_runs(rows, cuts, n, (lo, hi)) if n else [])]
    shard_of, first, begin = [0], [0], 0
    # boundaries in order; splitters that meet leave the shards between them empty
    bounds.sort(key=lambda x: (x[0], x[2] is None, x[2] or 0))
    for _, below, nth in bounds:
        if nth is not None:
            begin = below
        shard_of.append(shard_of[-1] if nth is None else nth)
        first.append(below - begin)
    ph, pd = (np.array([b[i] for b, _, _ in bounds], np.int64) for i in (0, 1))
    shard_of, first = np.array(shard_of, np.int32), np.array(first, np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = _places(batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False), ph, pd)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(shard_of[at]), pa.array(first[at])], names=["key", "size", "text_crc32", "h", "d", "run", "shard", "first"])

    placed = arrow_rows(rows, run, "key long, size long, text_crc32 long, h long, d long, run int, shard int, first long")
    slot = F.col("first") + F.row_number().over(Window.partitionBy("run").orderBy("h", "d")) - 1
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The same in DuckDB, for 24 shards. CRC-32 goes byte by byte through the table that its polynomial gives.
ORACLE = """
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 8 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
c AS (SELECT *, CAST(sum(size) OVER (ORDER BY h, doc_id) AS BIGINT) - size AS before FROM s),
t AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM s),
g AS (SELECT min(before) AS low, max(before + size) AS high FROM c GROUP BY h),
x AS (SELECT i, total, (total * i + 23) // 24 AS target FROM t, range(1, 24) r(i)),
y AS (SELECT i, total, target, coalesce((SELECT min(before) FROM c WHERE before >= target), total) AS raw FROM x),
z AS (SELECT CASE WHEN low IS NULL OR high - low > total // 2400 THEN raw WHEN target - low <= high - target THEN low ELSE high END AS b FROM y LEFT JOIN g ON low < raw AND raw < high),
p AS (SELECT c.*, (SELECT count(*) FROM z WHERE b <= before) AS shard FROM c),
k AS (SELECT list(v ORDER BY n) AS table_ FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, j: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(n))),
u AS (SELECT t, list_reduce(list_prepend(4294967295, list_transform(x, lambda b: CAST('0x' || b AS BIGINT))), lambda a, b: xor(a // 256, table_[xor(a % 256, b) + 1])) AS crc
  FROM (SELECT t, regexp_extract_all(hex(encode(t)), '..') AS x FROM (SELECT DISTINCT t FROM s)), k)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(crc, 4294967295) AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p JOIN u ON u.t = p.t
"""
