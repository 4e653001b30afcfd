"""Candidate pairs: standard blocking, load-balanced blocks, words of high inverse frequency, and locality-sensitive hashing."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, text
from ..session import Tables, durable, ship
from . import overlap
from .components import stars

# Words that never block.
STOP_WORDS = (
    "the", "i", "a", "an", "at", "are", "am", "for", "and", "or", "is", "there", "it", "this", "that", "on", "was", "by", "of", "to", "in",
    "not", "be", "with", "you", "have", "as", "can", "me", "my", "la", "de", "no", "unknown",
)


def _ends(df: DataFrame, name: str, key: list[str]) -> DataFrame:
    return df.select(*key, F.struct(*(c for c in df.columns if c not in key)).alias(name))


#: Rows of a block, or of one side of it, that meet in one task; larger blocks are cut into parts of about this size.
BLOCK_ROWS = 1000
#: Parts that a smaller limit may cut a block into; beyond, parts grow up to BLOCK_ROWS, as every row is sent to each part of its block.
SMALL_PARTS = 8


def _parts(n: Column, limit: int) -> Column:
    """The number of parts of a block of n rows."""
    wanted = F.ceil(n / limit)
    if limit < BLOCK_ROWS:
        wanted = F.least(wanted, F.greatest(F.lit(SMALL_PARTS), F.ceil(n / BLOCK_ROWS)))
    return wanted.cast("int")


def _spread(df: DataFrame, cell: list[str]) -> DataFrame:
    """Rows by cell, in a fixed number of partitions: adaptive execution would put small ones together by their bytes, which say nothing of the pairs they make."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *cell)


def pairs(df: DataFrame, key: str | list[str], accept: Column | None = None, limit: int = BLOCK_ROWS) -> DataFrame:
    """src, dst, s, t, key: every two rows of a block once, the smaller id first, that `accept` lets through.

    Blocks of over `limit` rows are cut into parts, and every two parts are a group of their own, where the rows of one meet
    those of the other and nothing else is compared: each row of a block of m parts goes to its m groups, so the load of a
    task is bounded whatever a block's size. Rows alone in a block don't move. A limit under BLOCK_ROWS makes SMALL_PARTS
    parts at most, or parts of BLOCK_ROWS rows where these are more.
    """
    key = [key] if isinstance(key, str) else key
    names = [c for c in df.columns if c not in key]
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key, _parts(F.col("_n"), limit).alias("_m"))
    rows = df.join(sizes, key).withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
    cell = [*key, "_i", "_j"]

    def side(name: str, i: Column, j: Column, others: Column) -> DataFrame:
        return _spread(rows.withColumn("_q", F.explode(others)).select(*key, i.alias("_i"), j.alias("_j"), F.struct(*names).alias(name)), cell)

    # part i on the one side, part j >= i on the other
    one = side("a", F.col("_p"), F.col("_q"), F.sequence(F.col("_p"), F.col("_m") - 1))
    two = side("b", F.col("_q"), F.col("_p"), F.sequence(F.lit(0), F.col("_p")))
    found = one.join(two, cell).where("_i < _j AND a.id <> b.id OR a.id < b.id")
    first = F.col("a.id") < F.col("b.id")
    end = lambda x, y, name: F.struct(*(F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(c) for c in names)).alias(name)
    found = found.select(*key, end("a", "b", "s"), end("b", "a", "t"))
    if accept is not None:
        found = found.where(accept)
    return found.select(F.col("s.id").alias("src"), F.col("t.id").alias("dst"), "s", "t", *key)


def split_pairs(df: DataFrame, key: str, accept: Column | None = None, limit: int = BLOCK_ROWS) -> DataFrame:
    """pairs() under the name of the load-balanced strategy, which is what pairs() always does."""
    return pairs(df, key, accept, limit)


def cross_pairs(left: DataFrame, right: DataFrame, key: str, accept: Column | None = None, limit: int = BLOCK_ROWS) -> DataFrame:
    """src, dst, s, t, key: every row of `left` with every row of `right` of its block, that `accept` lets through.

    The two sides of a large block are cut into parts, and every part of one meets every part of the other in a group of its own.
    """
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias("_n")).select(key, F.ceil(F.col("_n") / limit).cast("int").alias(n))
    sizes = count(left, "_a").join(count(right, "_b"), key)

    def dealt(df: DataFrame, own: str, other: str, cell: tuple[str, str], name: str) -> DataFrame:
        row = F.struct(*(c for c in df.columns if c != key)).alias(name)
        rows = df.join(sizes, key).select(key, F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(cell[0]), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(cell[1]), row)
        return _spread(rows, [key, "_i", "_j"])

    found = dealt(left, "_a", "_b", ("_i", "_j"), "s").join(dealt(right, "_b", "_a", ("_j", "_i"), "t"), [key, "_i", "_j"])
    if accept is not None:
        found = found.where(accept)
    return found.select(F.col("s.id").alias("src"), F.col("t.id").alias("dst"), "s", "t", key)


def disjoint(most: int | None = None) -> Column:
    """The ends share no source and have at most `most` together."""
    a, b = F.col("s.sources_int"), F.col("t.sources_int")
    out = ~bits.overlap(a, b)
    return out & (bits.count(a) + bits.count(b) <= most) if most else out


def with_new_source(bit: int) -> Column:
    """One end is exactly the new source, the other hasn't got it."""
    a, b = F.col("s.sources_int"), F.col("t.sources_int")
    return ~bits.overlap(a, b) & ((a == bit) | (b == bit))


def new_source_pairs(df: DataFrame, key: str, bit: int) -> DataFrame:
    """pairs() with with_new_source(bit): the rows of the new source meet those that lack it, and no others are compared."""
    mask = F.col("sources_int")
    found = cross_pairs(df.where((mask != 0) & (mask.bitwiseAND(bit) == 0)), df.where(mask == bit), key)
    first = F.col("src") < F.col("dst")
    end = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), end("s", "t").alias("s"), end("t", "s").alias("t"), key)


def nearest_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """src, dst, s, t (with `value`): of the pairs of a block, the smaller id first, those that links.max_both() can choose by near_sim of a whole number.

    For each row that is the next larger id (as src) and the smallest id (as dst) among the rows of its value, of each value one
    apart, of any value, and of all: whatever its best partner is, it is one of them, as ties go to the smaller partner. So
    rows are sorted inside their blocks, and no more than ten pairs a row are made.
    """
    v = text.sane_int(F.col(value))
    slot = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"))
    none, any_ = slot(2, F.lit(0)), slot(1, F.lit(0))
    rows = df.select("id", F.col(key).alias("_k"), value).where("_k IS NOT NULL")
    slots = lambda *of: F.explode(F.when(v.isNull(), F.array(none)).otherwise(F.array(*(slot(0, n) for n in of), any_, none))).alias("_s")
    row = F.struct("id", value)
    held = rows.select("id", value, "_k", slots(v)).withColumn("_own", F.lit(1))
    asked = rows.select("id", value, "_k", slots(v, v - 1, v + 1)).withColumn("_own", F.lit(0))
    # ids fall, and of one id the question comes first: the row held last is the next larger one
    falling = Window.partitionBy("_k", "_s").orderBy(F.desc("id"), "_own")
    after = held.unionByName(asked).withColumn("t", F.last(F.when(F.col("_own") == 1, row), ignorenulls=True).over(falling)).where("_own = 0 AND t IS NOT NULL").select(row.alias("s"), "t")
    least = held.groupBy("_k", "_s").agg(F.min(row).alias("s"))
    before = asked.join(least, ["_k", "_s"]).where("s.id < id").select("s", row.alias("t"))
    return after.unionByName(before).distinct().select(F.col("s.id").alias("src"), F.col("t.id").alias("dst"), "s", "t")


def with_lonely(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Pairs, and each row without one paired with itself."""
    met = found.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    alone = df.join(met, "id", "left_anti")
    row = F.struct(*(c for c in df.columns if c != key))
    return found.unionByName(alone.select(F.col("id").alias("src"), F.col("id").alias("dst"), row.alias("s"), row.alias("t"), key))


def place_pairs(df: DataFrame, key: str, most: int) -> DataFrame:
    """Pairs of places with disjoint sources and overlapping types; rows without one meet themselves."""
    return with_lonely(df, pairs(df, key, disjoint(most) & bits.overlap(F.col("s.types_int"), F.col("t.types_int"))), key)


def two_sided(df: DataFrame, key: str, bit: int) -> DataFrame:
    """Every row of the new source with every other row of its block; rows of a block that lacks a side meet themselves.

    A cluster that holds the new source and others is a mistake of the caller and raises an error in the task.
    """
    mixed = (F.col("sources_int").bitwiseAND(bit) != 0) & (F.col("sources_int") != bit)
    df = df.withColumn("sources_int", F.when(mixed, F.raise_error(F.lit("a cluster holds the new source already")).cast("long")).otherwise(F.col("sources_int")))
    is_new = F.col("sources_int") == bit
    found = cross_pairs(df.where(~is_new), df.where(is_new), key)
    # a row is lonely if its block lacks a side, which the blocks tell without the pairs
    whole = df.groupBy(key).agg(F.bool_or(is_new).alias("_new"), F.bool_or(~is_new).alias("_old")).where("_new AND _old").select(key)
    row = F.struct(*(c for c in df.columns if c != key))
    alone = df.join(whole, key, "left_anti")
    return found.unionByName(alone.select(F.col("id").alias("src"), F.col("id").alias("dst"), row.alias("s"), row.alias("t"), key))


def all_edges(df: DataFrame, key: str) -> DataFrame:
    """src, dst of every two rows with the same key."""
    return pairs(df.select("id", key), key).select("src", "dst")


def simple_edges(df: DataFrame, key: str) -> DataFrame:
    """src, dst: every row linked to the smallest id of its key."""
    least = df.groupBy(key).agg(F.min("id").alias("src"))
    return df.join(least, key).where("src < id").select("src", F.col("id").alias("dst"))


def cluster_pairs(df: DataFrame, members: str = "clustered") -> DataFrame:
    """src, dst: every two members of a cluster, the smaller id first."""
    sorted_ = F.array_sort(F.array_distinct(members))
    first = df.select(sorted_.alias("m")).select("m", F.posexplode("m").alias("i", "src"))
    return first.select("src", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("dst"))


def document_words(df: DataFrame, label: str = "label") -> DataFrame:
    """id, word: the distinct words of ASCII letters, in lower case, that aren't stop words."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(label)), r"\s+"), lambda w: w.rlike("^[a-z]+$")))
    return df.select("id", F.explode(words).alias("word")).where(~F.col("word").isin(*STOP_WORDS))


def term_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """id, word, n: how often each word of document_words() occurs in a row."""
    words = F.filter(F.split(F.lower(F.col(label)), r"\s+"), lambda w: w.rlike("^[a-z]+$"))
    rows = df.select("id", F.explode(words).alias("word")).where(~F.col("word").isin(*STOP_WORDS))
    return rows.groupBy("id", "word").agg(F.count("*").alias("n"))


def inverse_frequencies(words: DataFrame) -> DataFrame:
    """word, df, idf: logarithm of the sum of all frequencies divided (in integers) by the word's."""
    counts = words.groupBy("word").agg(F.count("*").alias("df"))
    total = counts.agg(F.sum("df").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("word", "df", F.log10(F.floor(F.col("total") / F.col("df"))).alias("idf"))


def top_words(words: DataFrame, idf: DataFrame, lowest: int | None = None) -> DataFrame:
    """id, word, idf: per row the half of its words (at least two) with the highest idf, ties included; or the `lowest` few.

    Words of one letter don't count. A value of idf is taken whole as long as fewer than the wanted number came before it.
    """
    rows = words.where(F.char_length("word") > 1).join(idf.select("word", "idf"), "word")
    order = Window.partitionBy("id").orderBy(F.col("idf") if lowest else F.desc("idf"))
    wanted = F.lit(lowest) if lowest else F.greatest(F.lit(2), F.ceil(F.count("*").over(Window.partitionBy("id")) / 2))
    return rows.withColumn("_w", wanted).withColumn("_r", F.rank().over(order)).where("_r <= _w").select("id", "word", "idf")


#: Words of the rows of a group of word_pairs(), about; every two groups meet in one task.
GROUP_WORDS = 6_000_000


def _word_lists(top: DataFrame, most_rows: int | None) -> DataFrame:
    """id, words: the sorted numbers of a row's words, of those that several rows have."""
    with Tables(top.sparkSession) as tables:
        rows = tables.keep(top.where("id IS NOT NULL AND word IS NOT NULL").select("id", "word"))
        counts = rows.groupBy("word").agg(F.count("*").alias("_n")).where("_n > 1")
        if most_rows:
            counts = counts.where(F.col("_n") <= most_rows)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        numbers = tables.keep(counts.select("word", F.spark_partition_id().alias("_part"), place.alias("_place")))
        sizes = numbers.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
        before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
        numbers = numbers.join(F.broadcast(before), "_part").select("word", (F.col("_before") + F.col("_place")).cast("int").alias("_word"))
        return durable(rows.join(numbers, "word").groupBy("id").agg(F.sort_array(F.collect_list("_word")).alias("words")))


def word_pairs(top: DataFrame, support: int = 2, most_rows: int | None = None) -> DataFrame:
    """src, dst, n: rows that share at least `support` of their words.

    Rows are dealt to groups of about GROUP_WORDS words by their ids, and every two groups meet in a task that counts the shared
    words of all their rows: a row is sent once a group, and pairs are not sent between tasks. Equal lists are counted once.

    most_rows leaves out words of more rows than that, for callers who want that cap; none is set by default.
    """
    spark = top.sparkSession
    ship(spark)
    rows = _word_lists(top, most_rows)
    n = -(-(rows.agg(F.sum(F.size("words"))).head()[0] or 0) // GROUP_WORDS)
    while n * (n + 1) < 4 * spark.sparkContext.defaultParallelism:  # two tasks a core at least
        n += 1
    own, other = F.col("_own"), F.col("_other")
    dealt = rows.select("id", "words", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("_own")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    high = F.greatest(own, other)
    cell = (F.floor(high * (high + 1) / 2) + F.least(own, other)).cast("int")
    cells = dealt.repartitionById(n * (n + 1) // 2, cell).sortWithinPartitions("id").select("id", "words", "_own", (own == other).alias("_same"))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, lists, group = (table.column(i).combine_chunks() for i in range(3))
        same = table.column(3)[0].as_py()
        held = table = None
        words, lengths, group = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), group.to_numpy()
        lists = None
        sides = []
        for g in np.unique(group):
            mine = group == g
            cuts = np.concatenate([[0], np.cumsum(lengths[mine])])
            sides.append(overlap.Side(np.flatnonzero(mine), words[np.repeat(mine, lengths)], cuts))
        if same or len(sides) == 2:  # rows are numbered in the order of ids
            for x, y, k in overlap.row_pairs(sides[0], sides[-1], support):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(k)], names=["src", "dst", "n"])

    kind = dict(rows.dtypes)["id"]
    return cells.mapInArrow(run, f"src {kind}, dst {kind}, n long")


def word_blocks(top: DataFrame, support: int = 2) -> DataFrame:
    """id, block: components of word_pairs, named by their smallest id."""
    return _components(word_pairs(top, support)).withColumnRenamed("component", "block")


def common_words(idf: DataFrame, n: int = 20) -> DataFrame:
    """The n words of the lowest idf."""
    return idf.orderBy("idf", "word").limit(n).select("word")


def without_common(df: DataFrame, common: DataFrame, label: str = "label") -> DataFrame:
    """id, label without the common words; as it was if too little (under 6 characters) is left. The common words are few."""
    listed = common.agg(F.collect_list("word").alias("_common"))  # one row of at most a few words
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(label)), r"\s+", " ")), " ")
    left = F.array_join(F.filter(words, lambda w: ~F.array_contains("_common", w)), " ")
    rows = df.join(F.broadcast(listed))
    return rows.select("id", F.when(F.char_length(left) >= 6, left).otherwise(F.lower(F.col(label))).alias("label"))


# --- locality-sensitive hashing over trigrams


class JavaRandom:
    """The 48-bit linear congruential generator of java.util.Random."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        out = self.state >> (48 - n)
        return out - (1 << n) if out >= 1 << (n - 1) and n == 32 else out

    def below(self, bound: int) -> int:
        got = self.bits(31)
        if bound & (bound - 1) == 0:
            return (bound * got) >> 31
        while got - got % bound + bound - 1 >= 1 << 31:
            got = self.bits(31)
        return got % bound


def sampled_positions(families: int = 15, hashes: int = 15, span: int = 3200, seed: int = 42) -> list[list[int]]:
    """For each family of hash functions the distinct bit positions that it looks at."""
    out = []
    for f in range(families):
        draw, found = JavaRandom(seed + f), []
        while len(found) < min(hashes, span):
            p = draw.below(span)
            if p not in found:
                found.append(p)
        out.append(found)
    return out


def trigram_ids(df: DataFrame, label: str = "label", span: int = 3200) -> tuple[DataFrame, DataFrame]:
    """(id, bits array<int>), (trigram, bit): dense numbers of trigrams by falling frequency, of which the first `span` count.

    The number of a trigram is its rank; only the `span` most frequent ones are ranked, on one task.
    """
    rows = df.select("id", F.explode(F.array_distinct(text.trigrams(label))).alias("trigram"))
    counts = rows.groupBy("trigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trigram").limit(span)
    numbers = counts.select("trigram", (F.row_number().over(Window.orderBy(F.desc("n"), "trigram")) - 1).alias("bit"))
    return rows.join(F.broadcast(numbers), "trigram").groupBy("id").agg(F.array_sort(F.collect_list("bit")).alias("bits")), numbers


def lsh_keys(sets: DataFrame, positions: list[list[int]]) -> DataFrame:
    """id, family, key: which of the family's positions are set; keys without any are left out."""
    families = F.array(*(F.struct(F.lit(f).alias("family"), F.array_intersect(F.array_sort(F.array(*(F.lit(p) for p in ps))), F.col("bits")).alias("key")) for f, ps in enumerate(positions)))
    return sets.select("id", F.explode(families).alias("k")).select("id", "k.family", F.concat_ws(",", F.transform("k.key", lambda x: x.cast("string"))).alias("key")).where("key <> ''")


#: How many times dearer a pair of a family's block is than two rows compared in numpy by the keys of all families: beyond that, blocks are not made.
DENSE = 20
#: Rows of a group of _dense_pairs(), at most, and rows of either side that are compared at once.
GROUP_KEYS, TILE = 20_000, 512


def _dense_pairs(table: DataFrame, families: int) -> DataFrame:
    """src, dst: rows (id, keys) that share a key that isn't 0 with another in the same place, each pair once, the smaller id first.

    Rows are dealt to groups by their ids, and every two groups meet in one task: a row is sent once a group, and pairs are not sent between tasks.
    """
    spark = table.sparkSession
    n = -(-table.count() // GROUP_KEYS)
    while n * (n + 1) < 8 * spark.sparkContext.defaultParallelism:  # four tasks a core at least
        n += 1
    own, other = F.col("_own"), F.col("_other")
    dealt = table.select("id", "keys", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("_own")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    high = F.greatest(own, other)
    cell = (F.floor(high * (high + 1) / 2) + F.least(own, other)).cast("int")
    cells = dealt.repartitionById(n * (n + 1) // 2, cell).sortWithinPartitions("id").select("id", "keys", "_own", (own == other).alias("_same"))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        ids, group, same = rows.column(0).combine_chunks(), rows.column(2).to_numpy(), rows.column(3)[0].as_py()
        keys = rows.column(1).combine_chunks().flatten().to_numpy().reshape(-1, families)
        if not same and len(np.unique(group)) < 2:
            return
        sides = [np.flatnonzero(group == g) for g in np.unique(group)]
        left, right = sides[0], sides[-1]
        a = np.ascontiguousarray(keys[left].T)
        b = np.ascontiguousarray(keys[right].T)
        a, b = np.where(a == 0, -1, a), np.where(b == 0, -2, b).astype(a.dtype)  # an empty key meets none
        for i in range(0, len(left), TILE):
            for j in range(i if same else 0, len(right), TILE):
                met = np.zeros((len(left[i : i + TILE]), len(right[j : j + TILE])), bool)
                one = np.empty_like(met)
                for f in range(families):
                    met |= np.equal(a[f, i : i + TILE, None], b[f, None, j : j + TILE], out=one)
                x, y = np.nonzero(met)
                x, y = left[i + x], right[j + y]
                if same and i == j:
                    x, y = x[x < y], y[x < y]
                x, y = np.minimum(x, y), np.maximum(x, y)  # rows are numbered in the order of ids
                if len(x):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y))], names=["src", "dst"])

    kind = dict(table.dtypes)["id"]
    return cells.mapInArrow(run, f"src {kind}, dst {kind}")


def lsh_pairs(sets: DataFrame, positions: list[list[int]]) -> DataFrame:
    """src, dst: rows that share a key of some family, each pair once: in the first family of which it shares the key, so no pair is sent between tasks.

    A key is a number whose bits are the set positions. Where few pairs share keys, a row goes with the numbers of all families to the block
    of each; else every two groups of rows meet in a task that compares all their rows (DENSE).
    """
    if any(len(ps) > 62 for ps in positions):
        return pairs(lsh_keys(sets, positions), ["family", "key"]).select("src", "dst").distinct()
    kind = "smallint" if all(len(ps) < 16 for ps in positions) else "bigint"
    listed, looked = F.array(*(F.array(*(F.lit(p) for p in ps)) for ps in positions)), F.array(*(F.lit(p) for p in sorted({p for ps in positions for p in ps})))
    number = lambda ps, found: F.aggregate(ps, F.lit(0).cast("bigint"), lambda n, p: n * 2 + F.array_contains(found, p).cast("bigint"))
    # bound by a lambda, the bits that any family looks at are found once a row
    numbers = F.get(F.transform(F.array(F.array_intersect("bits", looked)), lambda found: F.transform(listed, lambda ps: number(ps, found).cast(kind))), 0)
    table = durable(sets.where("id IS NOT NULL").select("id", numbers.alias("keys")).where(F.exists("keys", lambda k: k != 0)))
    rows = table.select("id", "keys", F.posexplode("keys").alias("family", "key")).where("key <> 0")
    sizes = rows.groupBy("family", "key").agg(F.count("*").cast("double").alias("n"))
    if (sizes.agg(F.sum(F.col("n") * F.col("n"))).head()[0] or 0) * DENSE > float(table.count()) ** 2:
        return _dense_pairs(table, len(positions))
    same = lambda f: (F.col("family") > f) & (F.get("s.keys", f) == F.get("t.keys", f)) & (F.get("s.keys", f) != 0)
    earlier = reduce(lambda x, y: x | y, (same(f) for f in range(len(positions) - 1)), F.lit(False))
    return pairs(rows, ["family", "key"], ~earlier).select("src", "dst")


def frequent_bits(sets: DataFrame, head: int, tail: int) -> DataFrame:
    """bit, n, place of the bits that are neither among the `head` rarest nor the `tail` most frequent."""
    counts = sets.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.orderBy("n", "bit"))).withColumn("last", F.count("*").over(Window.partitionBy()))
    return ranked.where((F.col("place") > head) & (F.col("place") <= F.col("last") - tail)).select("bit", "n", "place")


def bloom_bits(x: Column, size: int = 1024, hashes: int = 4) -> Column:
    """Sorted bit positions of a value in a Bloom filter, by double hashing of MD5 and SHA-1."""
    a, b = text.digest_int(x, "md5").cast("long"), text.digest_int(x, "sha1").cast("long")
    return F.array_sort(F.array_distinct(F.array(*(F.pmod(a + b * i, F.lit(size)).cast("int") for i in range(hashes)))))


def bloom_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def bloom_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def bloom_difference(a: Column, b: Column) -> Column:
    """Bits of exactly one of the two."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def may_hold(bits_: Column, x: Column, size: int = 1024, hashes: int = 4) -> Column:
    """Whether a value may be in a filter; never false for one that is."""
    return F.size(F.array_except(bloom_bits(x, size, hashes), bits_)) == 0


# --- strategies by name

#: no: one block for all rows, whose pairs grow with the square of the table; for small ones.
STRATEGIES = ("standard", "block_split", "idf", "lsh", "no")


def _components(links: DataFrame) -> DataFrame:
    """id, component of both ends of links (src, dst)."""
    merged = stars(links.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    heads = merged.select(F.col("component").alias("id"), "component").distinct()
    return merged.select(F.col("node").alias("id"), "component").unionByName(heads)


def blocked(df: DataFrame, strategy: str, key: Column, label: str = "label", support: int = 2) -> DataFrame:
    """df (id, label, ...) with `block`: the domain's key, or the component of rows that share rare words (idf) or a key of
    locality-sensitive hashing (lsh). Rows that these give no partner go by the domain's key, so none is left uncovered.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no blocking strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    if strategy in ("standard", "block_split"):
        return df.withColumn("block", key)
    if strategy == "no":
        return df.withColumn("block", F.lit(""))
    if strategy == "idf":
        words = document_words(df.select("id", F.col(label).alias("label")))
        found = word_pairs(top_words(words, inverse_frequencies(words)), support)
    else:
        sets, _ = trigram_ids(df, label)
        found = lsh_pairs(sets, sampled_positions())
    of = _components(found)
    block = F.coalesce(F.concat(F.lit(f"{strategy}:"), F.col("_component").cast("string")), F.concat(F.lit("key:"), key))
    return df.join(of.withColumnRenamed("component", "_component"), "id", "left").withColumn("block", block).drop("_component")


# --- sizes and places


def block_offsets(df: DataFrame, key: str) -> DataFrame:
    """key, n, pairs, before: rows and pairs of each block, and the pairs of all blocks before it in the order of keys.

    Keys are summed in ranges and the ranges' sums in one small window, so no task sees all blocks.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("pairs", F.floor(F.col("n") * (F.col("n") - 1) / 2))
    ranged = durable(sizes.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    ahead = ranged.groupBy("_part").agg(F.sum("pairs").alias("_sum"))  # a row a partition
    ahead = ahead.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_ahead"))
    inside = F.sum("pairs").over(Window.partitionBy("_part").orderBy(key)) - F.col("pairs")
    return ranged.withColumn("_inside", inside).join(F.broadcast(ahead), "_part").select(key, "n", "pairs", (F.col("_inside") + F.col("_ahead")).alias("before"))


def block_index(df: DataFrame, key: str) -> DataFrame:
    """df with `index`, the place (from 0) of each row in its block, in the order of ids, and `part`, its part of BLOCK_ROWS rows."""
    index = F.row_number().over(Window.partitionBy(key).orderBy("id")) - 1
    return df.withColumn("index", index).withColumn("part", F.floor(F.col("index") / BLOCK_ROWS).cast("int"))


# --- further hash functions


def random_positions(families: int, hashes: int, span: int, seed: int | None = None) -> list[list[int]]:
    """As sampled_positions(), drawn anew each time; a seed makes a draw that can be repeated."""
    draw = random.Random(seed)
    return [draw.sample(range(span), min(hashes, span)) for _ in range(families)]


def keys_of(bits_: Column, positions: list[list[int]]) -> Column:
    """The keys of one row: for each family the set positions that it looks at, as an array of arrays."""
    return F.array(*(F.array_intersect(F.array_sort(F.array(*(F.lit(p) for p in ps))), bits_) for ps in positions))


def shares_key(a: Column, b: Column) -> Column:
    """Whether two arrays of keys agree in a family, and not on an empty key."""
    same = F.zip_with(a, b, lambda x, y: (F.size(x) > 0) & (x == y))
    return F.exists(same, lambda x: F.coalesce(x, F.lit(False)))
