"""Operator 8, benchmark decontamination with SQL functions only.

Windows of `width` consecutive words of the benchmark items form a broadcast hash set. Each text is one array of words and
one array of their hashes; every window of it is looked up by a hash of its words' hashes, and only what hits is spelled
out and compared word by word with the items' windows. Items with fewer words are one window of their own length, so the
lookup is done for each length that occurs.

The hash set is a constant of the plan up to SET_LIMIT distinct windows. A larger benchmark takes a shuffled (or, where Spark
finds it small, broadcast) join over the exploded windows in its place; the result is the same. Windows with their items, of
which equal items make many, are broadcast up to SET_LIMIT rows and joined as Spark chooses beyond.

Defined cases: a null or empty text has no words and no hit; an item without words has no window; windows that repeat in
an item or among items count for every item that holds them; an empty benchmark hits nothing; equal texts give equal rows;
repeated and null keys are kept apart by a row number made in the scan; a very long text is an array of its words and one of
their hashes, some 80 bytes a word; an empty table gives an empty result; other columns are not read by scan(), whatever
their names, and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Fixed value: a word, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows in the constant hash set at most: about 8 MB.
SET_LIMIT = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; null has none. Where all is ASCII, lower() is the same and faster."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_hash(hashes: Column, at: Column, width: int) -> Column:
    """Hash of the words at, at + 1, ..., from the words' hashes."""
    return F.xxhash64(*(F.get(hashes, at + i) for i in range(width)))


def item_windows(benchmark: DataFrame, width: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: item, width, hash, window (its words joined by spaces)."""
    w = benchmark.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(width), F.size("w"))
    w = w.select("item", n.alias("width"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    w = w.select("item", "width", F.slice("w", F.col("at") + 1, F.col("width")).alias("w"))
    short = F.transform("w", lambda x: F.xxhash64(x))
    hashed = F.coalesce(*(F.when(F.col("width") == k, window_hash(short, F.lit(0), k)) for k in range(1, width + 1)))
    return w.select("item", "width", hashed.alias("hash"), F.array_join("w", " ").alias("window")).distinct()


def _places(w: Column, k: int) -> Column:
    """Where a window of k words can begin."""
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def _spelled(w: Column, i: Column, k: int) -> Column:
    return F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("window")


def _near(w: Column, h: Column, k: int, found: list[int]) -> Column:
    """Windows of k words whose hash is known, spelled out."""
    hit = F.filter(_places(w, k), lambda i: window_hash(h, i, k).isin(found))
    return F.transform(hit, lambda i: F.struct(F.lit(k).alias("width"), i.alias("at"), _spelled(w, i, k)))


def _spans(w: Column, h: Column, k: int) -> Column:
    """All windows of k words, with hash and words."""
    return F.transform(_places(w, k), lambda i: F.struct(F.lit(k).alias("width"), i.alias("at"), window_hash(h, i, k).alias("hash"), _spelled(w, i, k)))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: tuple[str, ...] = ("doc_id",), text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """`keep`, n_words, hits array<struct<item, width, at>> of each text: the windows of items that occur in it."""
    windows = item_windows(benchmark, width)
    known = windows.select("width", "hash").distinct().limit(set_limit + 1).collect()
    scanned = spread(docs.select(*keep, text)).select(*keep, F.monotonically_increasing_id().alias("_row"), words(F.col(text)).alias("_w"))
    scanned = scanned.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    if len(known) <= set_limit:
        sets: dict[int, list[int]] = {}
        for r in known:
            sets.setdefault(r["width"], []).append(r["hash"])
        parts = [_near(F.col("_w"), F.col("_h"), k, found) for k, found in sorted(sets.items())]
        kind = "array<struct<width:int,at:int,window:string>>"
        near = F.concat(*parts) if parts else F.array().cast(kind)
        rows = scanned.select(*keep, "_row", F.size("_w").cast("long").alias("n_words"), near.cast(kind).alias("_near"))
        hits = rows.select("_row", *keep, "n_words", F.explode_outer("_near").alias("_x"))
        hits = hits.select("_row", *keep, "n_words", F.col("_x.width").alias("width"), F.col("_x.at").alias("at"), F.col("_x.window").alias("window"))
        # compare the words themselves; the windows are as few as the hash set
        few = windows.limit(set_limit + 1).count() <= set_limit
        hits = hits.join(F.broadcast(windows.drop("hash")) if few else windows.drop("hash"), ["width", "window"], "left")
    else:
        lengths = [r["width"] for r in windows.select("width").distinct().collect()]  # at most `width` values
        spans = F.concat(*(_spans(F.col("_w"), F.col("_h"), k) for k in lengths))
        hits = scanned.select("_row", *keep, F.size("_w").cast("long").alias("n_words"), F.explode_outer(spans).alias("_x"))
        hits = hits.select("_row", *keep, "n_words", "_x.*").join(windows, ["width", "hash", "window"], "left")
    hit = F.when(F.col("item").isNotNull(), F.struct("item", "width", "at"))
    return hits.groupBy("_row", *keep).agg(F.max("n_words").alias("n_words"), F.collect_list(hit).alias("hits")).drop("_row")


def digests(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Per text: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs, benchmark, width)
    hit = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["width"] - 1))))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item"].cast("string"))))
    out = found.select("doc_id", "n_words", F.size(hit).cast("long").alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """Rows without any hit, with all their columns. A contaminated document goes whole: its rest belongs to a leaked item.

    With the windows themselves as a second constant set, this needs no exchange.
    """
    windows = item_windows(benchmark, width).select("width", "hash", "window").distinct()
    known = windows.limit(set_limit + 1).collect()
    if len(known) > set_limit:
        rows = scan(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{text}`").alias("_text")), benchmark, width, ("_doc",), "_text", set_limit)
        return rows.where(F.size("hits") == 0).select("_doc.*")
    sets: dict[int, list] = {}
    for r in known:
        sets.setdefault(r["width"], []).append(r)

    def leaks(x: Column) -> Column:
        hit = F.lit(False)
        for k, some in sorted(sets.items()):
            hit = hit | _holds(_near(x["w"], x["h"], k, [r["hash"] for r in some]), [r["window"] for r in some])
        return hit

    # bound by a lambda, the words are made once a row, wherever the optimizer puts the filter
    bound = F.transform(F.array(words(F.col(f"`{text}`"))), lambda w: F.struct(w.alias("w"), F.transform(w, lambda x: F.xxhash64(x)).alias("h")))
    return docs.where(~F.exists(bound, leaks))


def _holds(near: Column, windows: list[str]) -> Column:
    return F.exists(near, lambda x: x["window"].isin(windows))


#: The same in DuckDB.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, least(10, len(w)) AS width, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, width, array_to_string(w[p + 1 : p + width], ' ') AS win FROM i),
k AS (SELECT DISTINCT width FROM bw),
d AS (SELECT doc_id, width, w, unnest(range(0, len(w) - width + 1)) AS p FROM w, k WHERE len(w) >= width),
h AS (SELECT d.doc_id, bw.item_id, d.p, d.width FROM (SELECT doc_id, width, p, array_to_string(w[p + 1 : p + width], ' ') AS win FROM d) d JOIN bw ON bw.width = d.width AND bw.win = d.win),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + width)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
