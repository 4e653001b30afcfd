"""Operator 9, SimHash near-duplicates by BK-trees.

Fingerprints: a text's bit is 1 if it is set in over half the XXH64 hashes of its word shingles, repeats included.

Links: two fingerprints of 64 bits that differ in at most `radius` bits agree in one of radius + 1 bands of the bits, so
each distinct fingerprint goes to one shard a band: (band, its bits there). In every shard stands a BK-tree: children hang
under their parent by the integer Hamming distance to it, and a search with radius r follows from a node at distance d
only the edges d - r to d + r. All trees of a task are built and searched level by level at once in numpy. Trees aren't
broadcast: what they hold grows with the corpus, so a shard's tree and its searches meet by key in place of that.

A shard of more than `shard_limit` distinct fingerprints is divided again by bands of the bits that its key doesn't fix yet,
which is exact for the same reason, until shards are small or hold what few bits tell apart. At radius 4 the first division
leaves a 7,000th of evenly spread fingerprints in a shard and the second an 8,000,000th, at 5 and 25 copies of each, so with
8,192 to a shard one level serves 6 * 10^7 distinct fingerprints and two serve 6 * 10^10. Of a shard's links, a spanning star
of each of its components leaves the task; components of all shards are merged by alternating stars (operators/components.py).

Fingerprints are their own numbers here; keys come in after components are known.

Defined cases: null, empty and white-space texts have fingerprint zero and are linked like any other; texts with fewer
words than a shingle are one shingle; equal texts share a fingerprint, which is searched once; a null key takes part, links
others and never represents a component that has another key (one of null keys alone has a null component_id); repeated keys
are rows of their own; a very long text is hashed whole, about 100 bytes of memory a word; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars as components
from .bpe import groups
from .common import Tables, arrow_rows, as_bytes, durable, small_batches, spread

#: Distinct fingerprints of one shard's tree.
SHARD_LIMIT = 8192
#: Rows of shards that a task holds at a time, about.
HELD = 200_000
#: Pairs (search, node) that are looked at together; their children, some ten a pair, stand at one time.
FRONTIER = 100_000
#: Number of a row, while copies are sought.
ROW = "_kinweave_row"
#: More than any distance.
REACH = 256


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles of one text, repeats included."""
    parts = text.lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [joined] if parts else []
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        bits += np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """SimHash of one text."""
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, seed) for s in shingles(text, words)], np.uint64))


def fingerprints(df: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp (the fingerprint as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words) for some in groups(as_bytes(batch.column(1))) for t in some], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    return arrow_rows(spread(df.select(F.col(key).cast("long").alias("key"), text)), run, "key long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, of fingerprints of 64 bits or rows of several times 64."""
    bits = np.bitwise_count(a ^ b)
    return bits.sum(1, dtype=np.int64) if bits.ndim > 1 else bits.astype(np.int64)


class Forest:
    """BK-trees of many shards: shard[i] is the number of the shard that holds fp[i]; fp are distinct in a shard."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        _, self.root, back = np.unique(shard, return_index=True, return_inverse=True)
        self.root_of = self.root[back]
        parent = self.root_of.copy()
        edge = np.full(n, -1, np.int64)  # parent * REACH + distance, of each node but the roots
        left = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        while len(left):
            slot = parent[left] * REACH + distance(fp[left], fp[parent[left]])
            _, first, back = np.unique(slot, return_index=True, return_inverse=True)
            edge[left[first]] = slot[first]
            child = left[first][back]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, child = left[rest], child[rest]
            parent[left] = child
        order = np.argsort(edge, kind="stable")
        order = order[edge[order] >= 0]
        self.child, self.edge = order, edge[order]

    def search(self, some: np.ndarray, radius: int):
        """Pairs (i, j) of nodes in the same shard within the radius, i from `some`, in runs."""
        stack = [(some, self.root_of[some])]
        while stack:
            who, node = stack.pop()
            if len(who) > FRONTIER:
                stack.append((who[FRONTIER:], node[FRONTIER:]))
                who, node = who[:FRONTIER], node[:FRONTIER]
            d = distance(self.fp[who], self.fp[node])
            hit = (d <= radius) & (who != node)
            if hit.any():
                yield who[hit], node[hit]
            lo = np.searchsorted(self.edge, node * REACH + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.edge, node * REACH + np.minimum(d + radius, REACH - 1), "right") - lo
            if n.any():
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                stack.append((np.repeat(who, n), self.child[at]))

    def labels(self, radius: int, accept=None) -> np.ndarray:
        """For each node the smallest node of its component in its shard; `accept` may leave out pairs."""
        label = np.arange(len(self.fp))
        for lo in range(0, len(self.fp), 16_384):
            for a, b in self.search(np.arange(lo, min(lo + 16_384, len(self.fp))), radius):
                if accept is not None:
                    real = accept(a, b)
                    a, b = a[real], b[real]
                while True:
                    la, lb = label[a], label[b]
                    low, high = np.minimum(la, lb), np.maximum(la, lb)
                    if (low == high).all():
                        break
                    np.minimum.at(label, high, low)
                    while (label[label] != label).any():
                        label = label[label]
        return label


def whole_groups(batches, most: int):
    """Columns of batches that are sorted by the first, in runs of about `most` rows that part no group of equal values there."""
    held, count = [], 0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and count >= most and len(columns[0]):
            end = np.searchsorted(columns[0], held[-1][0][-1], "right")
            held.append([c[:end] for c in columns])
            columns = [c[end:] for c in columns]
            if len(columns[0]):  # the group that was open has ended
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held, count = [], 0
        if len(columns[0]):
            held.append(columns)
            count += len(columns[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def bands(width: int, parts: int) -> list[tuple[int, int]]:
    """Cut `width` bits into nearly equal bands: (first bit, number of bits)."""
    ends = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False) if b > a]


def _keyed(rows: DataFrame, free: str, radius: int) -> DataFrame:
    """Rows (fp, path, free) once for each band of the free bits; path grows by the band's bits.

    `free` is the list of bit numbers that path doesn't fix, as text; all rows here share it.
    """
    places = [int(x) for x in free.split(",")]
    keys = []
    for first, n in bands(len(places), radius + 1):
        own = places[first : first + n]
        mask = sum(1 << p for p in own)
        signed = mask - (1 << 64) if mask >> 63 else mask
        rest = ",".join(map(str, places[:first] + places[first + n :]))
        keys.append(F.struct(F.xxhash64(F.col("path"), F.lit(first), F.col("fp").bitwiseAND(F.lit(signed))).alias("path"), F.lit(rest).alias("free")))
    return rows.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")


def links(fps: DataFrame, radius: int, tables: Tables, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(u, v): fingerprints that connect what Hamming distances of at most `radius` connect; fps: distinct fp."""
    small_batches(fps.sparkSession)

    def run(batches):
        for shard, fp in whole_groups(batches, HELD):
            label = Forest(shard, fp.view(np.uint64)).labels(radius)
            real = label != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[real]), pa.array(fp[label[real]])], names=["u", "v"])

    todo = {",".join(map(str, range(64))): fps.select("fp", F.lit(0).cast("long").alias("path"))}
    out = None
    while todo:
        keyed = None
        for free, rows in todo.items():
            more = _keyed(rows, free, radius)
            keyed = more if keyed is None else keyed.unionByName(more)
        keyed = tables.keep(keyed)
        sizes = keyed.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        sizes = tables.keep(sizes.select("path", (F.col("n") > shard_limit).alias("hot")))
        met, todo = keyed.join(sizes, "path"), {}
        small = met.where(~F.col("hot")).drop("hot")
        # a key that is hot stands for over shard_limit rows, so these are a small part of all
        large = met.where("hot").drop("hot")
        for r in large.select("free").distinct().collect():  # one for each way to choose bands
            if len(r["free"].split(",")) > 12:
                todo[r["free"]] = large.where(F.col("free") == r["free"]).drop("free")
            else:
                small = small.unionByName(large.where(F.col("free") == r["free"]))  # at most 2^12 fingerprints
        found = tables.keep(small.select("path", "fp").repartition("path").sortWithinPartitions("path").mapInArrow(run, "u long, v long").distinct())
        out = found if out is None else out.unionByName(found)
    return out


def cluster(df: DataFrame, words: int = 4, radius: int = 4, text: str = "text", key: str = "doc_id", shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """key, fp (signed long), component_id (the smallest key reachable) of every row."""
    rows = durable(fingerprints(df, words, text, key))
    with Tables(df.sparkSession) as tables:
        fps = tables.keep(rows.groupBy("fp").agg(F.min("key").alias("key")))
        merged = components(links(fps.select("fp"), radius, tables, shard_limit))
        of = fps.join(merged.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "key", F.coalesce("component", "fp").alias("component"))
        least = of.groupBy("component").agg(F.min("key").alias("component_id"))
        of = durable(of.join(least, "component").select("fp", "component_id"))
    return rows.join(of, "fp").select(F.col("key").alias(key), "fp", "component_id")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return cluster(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with a number for each row: the key, where that is unique; else a number that is written down so that it stays."""
    n, keys = df.select(F.count("*"), F.count_distinct(key)).head()
    if n == keys and dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint"):
        return df.withColumn(ROW, F.col(key).cast("long"))
    return durable(df.withColumn(ROW, F.monotonically_increasing_id()))


def one_of_each(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Of numbered rows one of each component (ROW, component): that with the smallest key, of several such the first; one with a null key only where all have."""
    ordered = rows.select(ROW, F.struct(F.col(key).isNull(), key, ROW).alias("_order")).join(found, ROW)
    kept = ordered.groupBy("component").agg(F.min("_order")[ROW].alias("_kept"))
    gone = durable(ordered.join(kept, "component").where(F.col(ROW) != F.col("_kept")).select(ROW))
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def keep_one(df: DataFrame, words: int = 5, radius: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of fingerprints within the radius, as one_of_each() chooses it."""
    rows = numbered(df, key)
    return one_of_each(rows, cluster(rows, words, radius, text, ROW).select(ROW, F.col("component_id").alias("component")), key)
