"""Operator 3, exact top-k inner products by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 equal segments, and of each segment the mean and the deviation (root of the squared
distances from the mean) are kept. For two vectors, the squared distance is at least the sum over segments of
n * (difference of means)^2 + (difference of deviations)^2; with both norms that bounds the inner product from above:
score <= sum of n * mean * mean + deviation * deviation. Bounds are taken coarse to fine, each only for pairs that the
bound before left, against the k-th best score that a query has so far; survivors get their exact integer score.

The queries are a stated set, and both sides grow with the corpus, so neither is collected or broadcast. Queries go to rows
and candidates to columns of a grid of cells, by their place in the scan, so that no id or vector makes a cell larger. A cell's
queries, at most QUERY_BLOCK or so, come first and are held; its candidates stream past them. One exchange deals both sides;
of each cell only k rows a query go into a second one.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; an empty
vector scores 0 against any; vectors of another length than the query's are no candidates of it; fewer than k candidates give
all of them; ties go to the smaller id; repeated vectors and ids are rows of their own; without queries or candidates the
result is empty; other columns are not read, whatever their names. Where products may leave the integers that doubles hold,
candidates are first told apart by doubles with an error bound and then scored in arbitrary-precision integers. The order is
always that of the exact scores; a score beyond the range of long is given as that range's end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Queries of one cell, about; at 64 components their vectors are 16 MB. Candidates of a cell, about.
QUERY_BLOCK, CELL_ROWS = 32_768, 1_000_000
LEVELS = (1, 4, 16)
#: Candidates that are bounded at once.
TILE = 512
#: Vectors travel as their integers times 1 / UNIT, which no finite component takes out of range.
UNIT = 2.0**16


def integer_vectors(df: DataFrame, scale: int = 256, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """id, v array<double> with floor(scale * component) / UNIT, of the vectors that take part; scale is a power of two."""
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))

    def whole(x):
        y = x.cast("double")
        # doubles from 2^44 on are whole after scaling in any case
        return F.when(F.abs(y) < 2.0**44, F.floor(y * scale).cast("double") / UNIT).otherwise(y * (scale / UNIT))

    return df.where(sound).select(F.col(key).cast("long").alias("id"), F.transform(vector, whole).alias("v"))


def exact_integers(z: np.ndarray) -> list[int]:
    """The integers of one vector."""
    return [int(x * UNIT) if abs(x) < 2.0**900 else int(x) * int(UNIT) for x in z.tolist()]


def segment_stats(x: np.ndarray, level: int) -> np.ndarray:
    """sqrt(n) * mean and deviation of each of `level` segments, side by side: their products bound inner products."""
    parts = np.array_split(x, level, axis=1) if x.shape[1] else []
    means = [p.mean(1) for p in parts if p.shape[1]]
    spread = [np.sqrt(((p - m[:, None]) ** 2).sum(1)) for p, m in zip((p for p in parts if p.shape[1]), means, strict=True)]
    scaled = [m * np.sqrt(p.shape[1]) for m, p in zip(means, (p for p in parts if p.shape[1]), strict=True)]
    return np.stack([*scaled, *spread], 1) if means else np.zeros((len(x), 1))


def _stats(x: np.ndarray) -> list[np.ndarray]:
    return [segment_stats(x, min(level, max(1, x.shape[1]))) for level in LEVELS]


def _products(mine: np.ndarray, theirs: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of rows q of one with rows c of the other: as a whole matrix of the rows that occur, if the pairs fill enough of it."""
    rows, at = np.unique(q, return_inverse=True)
    columns, of = np.unique(c, return_inverse=True)
    if len(q) * 16 >= len(rows) * len(columns):
        return (mine[rows] @ theirs[columns].T)[at, of]
    return np.concatenate([np.einsum("ij,ij->i", mine[q[i : i + 65536]], theirs[c[i : i + 65536]]) for i in range(0, len(q), 65536)])


class Searcher:
    """Queries of one length (ids, integers / UNIT), and the best k candidates of each so far."""

    def __init__(self, ids: np.ndarray, z: np.ndarray, k: int):
        # with both sides up to `small`, inner products are integers that doubles hold
        self.small = float(np.sqrt(2.0**52 / max(1, z.shape[1])))
        self.ids, self.z, self.k = ids, z, k
        self.large = self._beyond(z)
        self.x = np.where(self.large[:, None], 0.0, z * UNIT) if self.large.any() else z * UNIT
        self.stats = _stats(self.x)
        self.score = np.full((len(ids), k), -np.inf)
        self.got = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.exact: dict[int, list[tuple[int, int]]] = {}

    def _beyond(self, z: np.ndarray) -> np.ndarray:
        return np.abs(z).max(1, initial=0) > self.small / UNIT

    def offer(self, ids: np.ndarray, z: np.ndarray) -> None:
        """Take up candidates."""
        large = self._beyond(z)
        if self.large.any() or large.any():
            self._offer_exactly(np.flatnonzero(self.large), ids[~large], z[~large])
            self._offer_exactly(np.arange(len(self.ids)), ids[large], z[large])
            ids, z = ids[~large], z[~large]
        vectors = z * UNIT
        stats = _stats(vectors)
        # large candidates first: they raise the k-th best score soonest
        order = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
        slack = 1e-6 * (1 + np.abs(vectors).max(initial=0) * np.abs(self.x).max(initial=0) * max(1, vectors.shape[1]))
        open_ = np.where(self.large, np.inf, 0.0)  # large queries have had theirs
        for lo in range(0, len(ids), TILE):
            some = order[lo : lo + TILE]
            least = self.score[:, -1] - slack + open_
            # coarsest level for all pairs of the tile, the finer ones for what is left
            q, c = np.nonzero(self.stats[0] @ stats[0][some].T >= least[:, None])
            for mine, theirs in zip(self.stats[1:], stats[1:], strict=True):
                if len(q):
                    keep = _products(mine, theirs[some], q, c) >= least[q]
                    q, c = q[keep], c[keep]
            if len(q):
                exact = _products(self.x, vectors[some], q, c)
                other = self.ids[q] != ids[some[c]]
                self._take(q[other], ids[some[c[other]]], exact[other])

    def _offer_exactly(self, queries: np.ndarray, ids: np.ndarray, z: np.ndarray) -> None:
        """The same where doubles don't hold the products: only what an error bound leaves is scored, in whole numbers."""
        if not len(queries) or not len(ids):
            return
        size = np.maximum(np.abs(z).max(1, initial=0), 1e-300)
        even, whole = z / size[:, None], {}
        for q in queries.tolist():
            mine = self.z[q] / max(np.abs(self.z[q]).max(initial=0), 1e-300)
            value, error = (even @ mine) * (size * 2.0**-20), (np.abs(even) @ np.abs(mine)) * (size * 2.0**-20) * (1e-14 * (len(mine) + 4))
            other = np.flatnonzero(ids != self.ids[q])
            if len(other) > self.k:
                least = np.partition((value - error)[other], -self.k)[-self.k]
                other = other[(value + error)[other] >= least]
            own = exact_integers(self.z[q])
            for i in other.tolist():
                if i not in whole:
                    whole[i] = exact_integers(z[i])
            found = [(-sum(a * b for a, b in zip(own, whole[i], strict=True)), int(ids[i])) for i in other.tolist()]
            self.exact[q] = sorted(self.exact.get(q, []) + found)[: self.k]

    def best(self) -> list[tuple[int, int, int]]:
        """(query, candidate, score) of what has been found, up to 2 k for a query."""
        q, at = np.nonzero(self.score > -np.inf)
        out = [(int(self.ids[i]), int(self.got[i, j]), int(self.score[i, j])) for i, j in zip(q, at, strict=True)]
        return out + [(int(self.ids[i]), c, -score) for i, found in self.exact.items() for score, c in found]

    def _take(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.score[q, -1]
        q, ids, score = q[keep], ids[keep], score[keep]
        if not len(q):
            return
        hit = np.unique(q)
        q, ids, score = np.concatenate([q, np.repeat(hit, self.k)]), np.concatenate([ids, self.got[hit].ravel()]), np.concatenate([score, self.score[hit].ravel()])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, hit)
        at = first[:, None] + np.arange(self.k)
        self.got[hit], self.score[hit] = ids[at], score[at]


LEAST, MOST = -(2**63), 2**63 - 1


def beyond_long(score: int) -> bytes:
    """Sorts scores that long holds the end of its range for: as bytes, with the scores that it holds in the middle."""
    if LEAST <= score <= MOST:
        return b"\x01"
    size = (abs(score).bit_length() + 7) // 8
    if score > 0:
        return b"\x02" + size.to_bytes(4, "big") + score.to_bytes(size, "big")
    return b"\x00" + (2**32 - 1 - size).to_bytes(4, "big") + (256**size - 1 + score).to_bytes(size, "big")


FOUND = "query_id long, vec_id long, score long, beyond binary"


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (id, v) of every query (id, v), which is not its own candidate."""
    spark = queries.sparkSession
    small_batches(spark)
    rows = max(1, -(-queries.count() // block))
    columns = max(1, -(-candidates.count() // CELL_ROWS), -(-4 * spark.sparkContext.defaultParallelism // rows))
    place = F.monotonically_increasing_id()
    across = queries.select(F.pmod(place, F.lit(rows)).alias("at"), F.lit(0).alias("side"), "id", "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    down = candidates.select(F.pmod(place, F.lit(columns)).alias("at"), F.lit(1).alias("side"), "id", "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    dealt = across.select((F.col("at") * columns + F.col("other")).alias("cell"), "side", "id", "v")
    dealt = dealt.unionByName(down.select((F.col("other") * columns + F.col("at")).alias("cell"), "side", "id", "v"))

    def unpack(batch):
        """Of each length: ids and vectors."""
        ids, lists = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(sizes) - sizes
        for s in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == s)
            yield s, ids[at], flat[start[at][:, None] + np.arange(s)].reshape(len(at), s)

    def give(searchers):
        out = [x for s in searchers.values() for x in s.best()]
        for lo in range(0, len(out), 50_000):
            qs, cs, scores = zip(*out[lo : lo + 50_000], strict=True)
            held = [min(max(x, LEAST), MOST) for x in scores]
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(cs, pa.int64()), pa.array(held, pa.int64()), pa.array([beyond_long(x) for x in scores], pa.binary())], names=[x.split()[0] for x in FOUND.split(", ")])

    def run(batches):
        cell, asked, searchers = None, {}, None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                now, side = divmod(int(keys[lo]), 2)
                if now != cell:
                    yield from give(searchers or {})
                    cell, asked, searchers = now, {}, None
                if not side:
                    for s, ids, z in unpack(batch.slice(lo, hi - lo)):
                        asked.setdefault(s, []).append((ids, z))
                    continue
                if searchers is None:
                    searchers = {s: Searcher(*map(np.concatenate, zip(*parts, strict=True)), k) for s, parts in asked.items()}
                    asked = {}
                for s, ids, z in unpack(batch.slice(lo, hi - lo)):
                    if s in searchers:
                        searchers[s].offer(ids, z)
        yield from give(searchers or {})

    found = dealt.repartition(rows * columns, "cell").sortWithinPartitions("cell", "side").mapInArrow(run, FOUND)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top5(embeddings: DataFrame) -> DataFrame:
    """Queries: ids divisible by 50; candidates: every other row."""
    rows = integer_vectors(embeddings)
    return search(rows.where(F.col("id") % 50 == 0), rows, 5)


#: The same in DuckDB.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
