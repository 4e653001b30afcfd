"""Operator 10, removal of repeated 200-byte strings by suffix arrays.

Texts of a corpus don't fit one array, so suffixes are dealt to shards by content. Of the k-grams in a 200-byte window the
one with the smallest hash (the leftmost on ties) is its anchor; equal windows have equal anchors at the same place, and
neighbouring windows mostly share one, so a text is a sequence of runs of windows with one anchor each. A run's region is
the text that its windows cover, some 290 bytes. All windows with equal content lie in regions of equal anchors. So:

1. every text gives its runs: (anchor hash, region hash, place);
2. anchors that occur once are dropped; equal regions become one with a weight;
3. the bytes of each distinct region are fetched once and go to the shard of their anchor, where the suffix array and the
   permuted common prefixes of all its regions are computed (suffix_sort.py); windows whose common prefix reaches 200 form
   a class, and those of a class with weight over one are repeated;
4. the repeated places of a region are joined back to all its occurrences, and texts lose the bytes that they cover.

An anchor with more than HOT distinct regions is divided further: its windows are grouped by the anchor's place in them,
in steps of 64, and by the content that all windows of such a group share, and regions are cut to these groups. Parts that
are alone in their group go, equal ones become one with a weight, and groups that still hold more than HOT distinct parts are
cut again, in steps of 16, 4 and 1; in the last a group is one window. Only what is in an over-full group is cut again, so a
region gives some parts a step where it would give 177 windows. Each division keeps equal windows together, so results are
exact, and no group grows with the corpus.

Hashes only bring candidates together, but for "equal regions", which trusts 64 bits of anchor and 64 of region.

Defined cases: a null text counts as empty; texts under 200 bytes lose nothing; matches never cross texts; a string that
overlaps itself counts; equal texts of 200 bytes or more lose all bytes; repeated rows are documents of their own; a null
or repeated key is fine; a very long text is hashed as one buffer (about 40 bytes of memory a byte) and its runs go to the
shards like any other's; an empty table gives an empty result; other columns are kept by clean() and never read.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .bpe import groups
from .common import Tables, arrow_rows, as_bytes, durable, lean, small_batches, spread
from .suffix_sort import common_prefixes, suffix_array

LENGTH, GRAM = 200, 24
#: Bytes of texts whose runs are found at once (some 40 bytes of memory a byte, and the hashes), of one suffix array, and distinct
#: regions of one anchor before it is divided.
RUN_BYTES, ARRAY_BYTES = 500_000, 1_000_000
HOT, STEPS = 2048, (64, 16, 4, 1)
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each place on, by doubling a polynomial; the last places run over the end."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    done, out, left = 0, None, gram
    base, size = _BASE, 1
    with np.errstate(over="ignore"):
        while True:
            if left & size:
                if out is None:
                    out = h.copy()
                else:
                    out[: len(out) - done] = out[: len(out) - done] * base + h[done:] if done else out
                done += size
                left -= size
            if not left:
                break
            nxt = h * base
            nxt[:-size or None] += h[size:]
            h, base, size = nxt, base * base, size * 2
        out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out


def runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor, of texts that lie in one buffer of under 2^23 bytes or are alone in it.

    Gives the text's number, the first window's place in it, the region's size and the anchor's hash of each run.
    """
    n, m = len(data), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    h = gram_hashes(data, gram)
    bits = np.uint64(int(n).bit_length())
    key = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    pad = -n % m
    key = np.concatenate([key, np.full(pad + m, np.uint64(2**64 - 1))]).reshape(-1, m)
    ahead = np.minimum.accumulate(key, 1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[: n - length + 1], ahead[m - 1 : n - length + m])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[text] + place
    anchor = anchor[at]
    if not len(at):
        return none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(first, len(at)))
    return text[first], place[first], count + length - 1, h[anchor[first]]


def _anchors(rows: DataFrame, length: int, bits: int) -> DataFrame:
    """h, rhash, occ (row, and in its last `bits` bits the place), size of every run of rows (row, text)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            done = 0
            for some in groups(as_bytes(batch.column(1)), RUN_BYTES):
                joined = b"".join(some)
                sizes = np.fromiter(map(len, some), np.int64, len(some))
                starts = np.cumsum(sizes) - sizes
                text, place, size, h = runs(np.frombuffer(joined, np.uint8), starts, sizes, length)
                if len(text):
                    digest, at = xxhash.xxh3_64_intdigest, (starts[text] + place).tolist()
                    rhash = np.fromiter((digest(joined[a : a + s]) for a, s in zip(at, size.tolist(), strict=True)), np.uint64, len(at))
                    occ = (ids[done + text] << bits) | place
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rhash.view(np.int64)), pa.array(occ), pa.array(size.astype(np.int32))], names=["h", "rhash", "occ", "size"])
                done += len(some)

    small_batches(rows.sparkSession)
    return spread(rows.select("row", "text")).mapInArrow(lean(run), "h long, rhash long, occ long, size int")


REGION = "g long, rhash long, n long, hot boolean, bytes binary"


def _fetch(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """The bytes of each distinct region, from the text of its first occurrence."""
    place = F.col("rep").bitwiseAND(F.lit((1 << bits) - 1))
    at = F.collect_list(F.struct("g", "rhash", "n", "hot", place.alias("place"), "size"))
    places = wanted.groupBy(F.shiftright("rep", bits).alias("row")).agg(at.alias("at"))
    columns = ["g", "rhash", "n", "hot", "place", "size"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = batch.column(1).value_lengths().to_pylist()
        g, rhash, n, hot, place, size = (batch.column(i).flatten() for i in range(1, 7))
        spans, out = zip(place.to_pylist(), size.to_pylist(), strict=True), []
        for text, k in zip(as_bytes(batch.column(0)), counts, strict=True):
            out += [text[p : p + s] for p, s in islice(spans, k)]
        return pa.RecordBatch.from_arrays([g, rhash, n, hot, pa.array(out, pa.binary())], names=["g", "rhash", "n", "hot", "bytes"])

    return arrow_rows(rows.join(places, "row").select("text", *(F.col(f"at.{c}").alias(c) for c in columns)), run, REGION)


def repeated(regions: list[bytes], weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each region, the first and last place of every run of windows that occur more than once, by weight."""
    sizes = np.fromiter(map(len, regions), np.int64, len(regions))
    text = np.frombuffer(b"".join(regions), np.uint8)
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(regions), dtype=np.int32), sizes)
    place = np.arange(len(text), dtype=np.int32) - np.repeat(start.astype(np.int32), sizes)
    window = place <= np.repeat((sizes - length).astype(np.int32), sizes)
    sa = suffix_array(text)
    same = common_prefixes(text, sa)[sa] >= length
    of = np.cumsum(~same)
    real = window[sa]
    total = np.bincount(of, np.where(real, weights[owner[sa]], 0))
    found = np.zeros(len(text), bool)
    found[sa] = real & (total[of] > 1)
    edge = np.diff(np.concatenate([[False], found, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    # windows at a region's end are never beside the next region's first, as the last length - 1 places hold none
    whose = owner[first]
    spans = np.stack([place[first], place[last]], 1)
    cut = np.searchsorted(whose, np.arange(len(regions) + 1))
    return [spans[a:b] for a, b in zip(cut, cut[1:], strict=False)]


SPANS = "g long, rhash long, spans array<int>"


def _sorted_shards(regions: DataFrame, parts: int, length: int) -> DataFrame:
    """g, rhash, spans of the regions (g, rhash, n, bytes) with repeated windows; regions of equal g meet in one array."""

    def solve(rows):
        found = repeated([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), length)
        out = [(r[0], r[1], s.ravel().tolist()) for r, s in zip(rows, found, strict=True) if len(s)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["g", "rhash", "spans"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= ARRAY_BYTES and row[0] != rows[-1][0]:
                    yield from solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield from solve(rows)

    return regions.select("g", "rhash", "n", "bytes").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(lean(run), SPANS)


def narrow(region: bytes, step: int, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, bytes]]:
    """Parts of a region for groups of windows with the anchor at about the same place: (group hash, first window, bytes)."""
    windows = len(region) - length + 1
    h = gram_hashes(np.frombuffer(region, np.uint8), gram)
    bits = np.uint64(len(region).bit_length())
    key = (h >> bits << bits) | np.arange(len(region), dtype=np.uint64)
    anchor = int(key[: length - gram + 1].argmin())
    out, s = [], 0
    while s < windows:
        # windows s .. e have the anchor at places of one step
        q = (anchor - s) // step
        e = min(windows - 1, anchor - q * step)
        shared = region[anchor - q * step : anchor - q * step - step + 1 + length]
        group = xxhash.xxh64_intdigest(shared, q) ^ int(h[anchor])
        out.append((group - (1 << 64) if group >> 63 else group, s, region[s : e + length]))
        s = e + 1
    return out


def _divided(regions: DataFrame, step: int, length: int) -> DataFrame:
    """Members of over-full groups (g, rhash, n, bytes) cut by narrow(): g, rhash, n, bytes of the parts, with of_g, of_rhash, first to lead back."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for of_g, of_rhash, n, data in zip(*(batch.column(c).to_pylist() for c in ("g", "rhash", "n", "bytes")), strict=True):
            for g, first, part in narrow(data, step, length):
                p = xxhash.xxh3_64_intdigest(part)
                out.append((g, p - (1 << 64) if p >> 63 else p, n, part, of_g, of_rhash, first))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["g", "rhash", "n", "bytes", "of_g", "of_rhash", "first"])

    return arrow_rows(regions.select("g", "rhash", "n", "bytes"), run, "g long, rhash long, n long, bytes binary, of_g long, of_rhash long, first int")


def _shared(distinct: DataFrame, may_be_hot: bool) -> DataFrame:
    """g, hot of the groups of distinct (g, rhash, n) that hold more than one occurrence; hot where over HOT are distinct."""
    sums = distinct.groupBy("g").agg(F.sum("n").alias("t"), F.count("*").alias("d")).where(F.col("t") > 1)
    return sums.select("g", (F.lit(may_be_hot) & (F.col("d") > HOT)).alias("hot"))


def _spans(regions: DataFrame, steps: tuple[int, ...], parts: int, length: int, tables: Tables) -> DataFrame:
    """g, rhash, spans of all regions (g, rhash, n, hot, bytes); a region may have several rows."""
    out = _sorted_shards(regions.where(~F.col("hot")), parts, length)
    hot = regions.where("hot")
    if not steps or hot.head() is None:
        return out
    cut = tables.keep(_divided(hot, steps[0], length))
    # equal parts become one, and lone ones go, before any of them meet
    shared = _shared(cut.groupBy("g", "rhash").agg(F.sum("n").alias("n")), len(steps) > 1)
    one = cut.join(shared, "g").groupBy("g", "rhash", "hot").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
    found = _spans(tables.keep(one), steps[1:], parts, length, tables)
    back = cut.select("g", "rhash", "of_g", "of_rhash", "first").join(found, ["g", "rhash"])
    return out.unionByName(back.select(F.col("of_g").alias("g"), F.col("of_rhash").alias("rhash"), F.transform("spans", lambda x: x + F.col("first")).alias("spans")))


def _numbered(df: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    """df with a column row (the key, where that is unique and fits; else a written number), and the bits that any place in a text needs."""
    n, some, least, most, longest = df.select(F.count("*"), F.count_distinct(key), F.min(key), F.max(key), F.max(F.octet_length(text))).head()
    bits = (longest or 0).bit_length()
    if n >= 1 << (62 - bits):
        raise ValueError(f"{n} texts of up to {longest} bytes need more than 62 bits for a place")
    if n == some and (n == 0 or (least >= 0 and most < 1 << (62 - bits))):
        return df.withColumn("row", F.col(key).cast("long")), bits
    numbered = durable(df.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("n"))  # a row a partition
    starts = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    out = numbered.join(starts, "_part").withColumn("row", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_part", "_id", "_before"), bits


def covers(rows: DataFrame, bits: int, length: int = LENGTH) -> DataFrame:
    """row, starts and ends (arrays of the same length) of the texts (row, text) with repeated bytes; the spans between them may overlap."""
    spark = rows.sparkSession
    with Tables(spark) as tables:
        anchors = tables.keep(_anchors(rows, length, bits))
        distinct = anchors.groupBy(F.col("h").alias("g"), "rhash").agg(F.count("*").alias("n"), F.min("occ").alias("rep"), F.max("size").alias("size"))
        wanted = tables.keep(distinct.join(_shared(distinct, True), "g"))
        regions = tables.keep(_fetch(rows, wanted, bits))
        tables.drop(tables.paths[-2])
        size = regions.count() * 300  # bytes, about
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // 16_000_000)
        spans = _spans(regions, STEPS, parts, length, tables)
        place = F.col("occ").bitwiseAND(F.lit((1 << bits) - 1))
        pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct((place + F.get("spans", i * 2)).alias("from"), (place + F.get("spans", i * 2 + 1) + length).alias("to")))
        found = anchors.select(F.col("h").alias("g"), "rhash", "occ").join(spans, ["g", "rhash"]).select(F.shiftright("occ", bits).alias("row"), F.explode(pairs).alias("s"))
        ordered = found.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("s"))
        return durable(ordered.select("row", F.col("s.from").alias("starts"), F.col("s.to").alias("ends")))


def merged(starts: list[int] | None, ends: list[int] | None) -> list[tuple[int, int]]:
    """Maximal removed runs, in order, of spans sorted by their starts."""
    out: list[tuple[int, int]] = []
    from_, to = -1, -1
    for a, b in zip(starts or (), ends or (), strict=True):
        if a <= to:
            to = max(to, b)
        else:
            if to >= 0:
                out.append((from_, to))
            from_, to = a, b
    return [*out, (from_, to)] if to >= 0 else out


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def digests(df: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per text: key, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, bits = _numbered(df.select(key, F.col(text).alias("text")), "text", key)
    joined = rows.join(covers(rows, bits, length), "row", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, starts, ends in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            spans = merged(starts, ends)
            left = kept(data, spans)
            out.append((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_rows(joined.select(key, "text", "starts", "ends"), run, f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(df: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", chars: str | None = "n_chars") -> DataFrame:
    """All rows and columns of df, texts without the repeated bytes; `chars`, if there, is the new number of characters.

    A character that loses some of its bytes goes whole. A null text stays null.
    """
    named, bits = _numbered(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_doc"), F.col(text).alias("text"), F.col(key).alias("_key")), "text", "_key")
    joined = named.join(covers(named.select("row", "text"), bits, length), "row", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else kept(t, merged(a, b)).decode("utf-8", "ignore") for t, a, b in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_doc", "_text"])

    out = arrow_rows(joined.select("_doc", "text", "starts", "ends"), run, StructType([named.schema["_doc"], StructField("_text", StringType())]))
    columns = [F.col("_text").alias(c) if c == text else F.char_length("_text").cast(dict(df.dtypes)[c]).alias(c) if c == chars else F.col(f"_doc.`{c}`").alias(c) for c in df.columns]
    return out.select(*columns)
