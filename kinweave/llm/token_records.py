"""Operator 1, token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A shard is a file of records in ascending key order, and a record is

    u64 length of the payload | u32 masked crc of these 8 bytes | payload | u32 masked crc of the payload | line feed

with little-endian numbers and, as payload, i64 key, u32 number of ids, and the ids as u16 (vocabularies up to 65,536)
or u32. The mask (rotate by 15, add a constant) keeps a checksum of data that itself holds checksums sound.

Rows go to tasks by ranges of (key, place in the scan), so that equal and null keys are spread too. A task makes bundles of
about SHARD_BYTES bytes of records, and Spark's own writer gives each bundle a file of its own, so a shard is bounded by its
bytes whatever the texts' sizes, and the writer's commit protocol covers lost executors and any store that Spark can write.
Shards are ordered by task and by the number of the file in its task, both read from the file's name as numbers. The offset
index is a Parquet table (part, shard, key, offset, n_tokens, before, ids_crc32; before: ids of the records before it in its
shard), made while the written shards are read and verified; read_some() fetches records through it in any order. Ids before
a shard are sums over windows of shards, in two levels, without a list of shards on the driver.

Defined cases: a null text counts as empty and gives a record that holds only the end id; rows with equal keys stay
apart, in the order of the scan; a null key is written as the smallest long, comes first and comes back as null (the smallest
long itself is read as null); a text beyond SHARD_BYTES is a shard of its own; an empty table gives no shards and an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Memory, groups, load
from .common import KEPT, as_bytes, scratch, small_batches, written

#: Fixed values of the masked checksum, as in common record formats.
MASK_ROTATE, MASK_ADD = 15, 0xA282EAD8
HEAD, TAIL = 12, 5
NULL_KEY = -(2**63)
#: Bytes of records in a shard, beyond which it ends. A shard is read back as one row, so this bounds the memory of a reading task.
SHARD_BYTES = 8_000_000
#: Text bytes of a task, about.
TASK_BYTES = 16_000_000
#: Shards whose sums one window adds up.
SUMMED = 10_000
#: Fixed by Spark's writers: number of the task and, at the end, of the file in it; a group of the UUID between them may begin like the latter.
file_name = re.compile(r"part-(\d+)-.*-c(\d+)(?:\.[^-]*)?$").search


def masked(crc: int) -> int:
    return (((crc >> MASK_ROTATE) | (crc << (32 - MASK_ROTATE))) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without the line feed that ends it; the writer adds that."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(data: bytes, at: int = 0) -> tuple[memoryview, int]:
    """The payload of the record at this offset, and where the next one starts; raises ValueError on damage."""
    view = memoryview(data)
    if at + HEAD > len(data):
        raise ValueError(f"record at {at}: cut head")
    length, crc = struct.unpack_from("<QI", data, at)
    if crc != masked(zlib.crc32(view[at : at + 8])):
        raise ValueError(f"record at {at}: damaged length")
    end = at + HEAD + length
    if end + TAIL > len(data):
        raise ValueError(f"record at {at}: cut payload")
    payload = view[at + HEAD : end]
    if struct.unpack_from("<I", data, end)[0] != masked(zlib.crc32(payload)):
        raise ValueError(f"record at {at}: damaged payload")
    return payload, end + TAIL


def ids_of(payload: memoryview, wide: bool) -> tuple[int, np.ndarray]:
    key, n = struct.unpack_from("<qI", payload)
    return key, np.frombuffer(payload, "<u4" if wide else "<u2", n, 12)


@lru_cache(maxsize=2)
def _memory(path: str) -> Memory:
    """Ids of words as bytes, by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    # words are normalised and split already, so only the spaces between them part them
    model.normalizer = None
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    kind = "I" if model.get_vocab_size() > 65_536 else "H"

    final = np.zeros(model.get_vocab_size(), bool)
    for token, i in model.get_vocab().items():
        final[i] = token.endswith("</w>")

    def make(keys):
        # A word is text in the form that the tokenizer gives it before merging, which it leaves alone. Many go through at
        # once, and the ids that end words part them again. Ids of special tokens are keys, too.
        words = [k for k in keys if type(k) is str]
        coded = {k: array(kind, (k,)).tobytes() for k in keys if type(k) is int}
        for lo in range(0, len(words), 500):
            some = words[lo : lo + 500]
            ids = np.array(model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, kind)
            data, ends = ids.tobytes(), ((np.flatnonzero(final[ids]) + 1) * ids.itemsize).tolist()
            coded |= zip(some, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True)
        return [coded[k] for k in keys]

    return Memory(make)


KEPT.append(_memory.cache_clear)


def is_wide(path: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size() > 65_536


def write(df: DataFrame, out: str, path: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    """Write the records of all rows to `out`, shards and rows in ascending key order.

    path: a tokenizer file of the kind that bpe.WordBPE reads, as word_bpe_49k.json.
    """
    spark = df.sparkSession
    wide = is_wide(path)
    size = df.select(F.sum(F.octet_length(text) + 64)).head()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES))
    end = np.array([end_id], "<u4" if wide else "<u2").tobytes()
    most = SHARD_BYTES

    def run(batches):
        splitter, memory, each = load(path), _memory(path), 4 if wide else 2
        bundle, held = [], 0
        for batch in batches:
            at, keys = 0, batch.column(0).to_pylist()
            for some in groups(as_bytes(batch.column(1))):
                split = [splitter.words(t.decode("utf-8", "replace")) for t in some]
                memory.learn(split)
                for ws in split:
                    ids = b"".join([*map(memory.__getitem__, ws), end])
                    bundle.append(frame(struct.pack("<qI", NULL_KEY if keys[at] is None else keys[at], len(ids) // each) + ids))
                    at += 1
                    held += len(bundle[-1]) + 1
                    if held >= most:
                        yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(bundle)], pa.binary())], names=["records"])
                        bundle, held = [], 0
        if bundle:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(bundle)], pa.binary())], names=["records"])

    small_batches(spark)
    order = [F.col("key").asc_nulls_first(), F.col("place").asc()]
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("key", "text")
    bundles = rows.mapInArrow(run, "records binary").select(F.col("records").cast("string").alias("value"))
    bundles.write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(out)
    spark.createDataFrame([(wide,)], "wide boolean").coalesce(1).write.json(f"{out}-format")


def index(spark: SparkSession, out: str) -> DataFrame:
    """Read and verify all shards; write and return the offset index (part, shard, key, offset, n_tokens, before, ids_crc32)."""
    wide = spark.read.schema("wide boolean").json(f"{out}-format").head()[0]
    small_batches(spark)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                task, nth = map(int, file_name(name).groups())
                data, at, keys, places, sizes, sums = data.as_buffer().to_pybytes(), 0, [], [], [], []
                while at < len(data):
                    payload, after = unframe(data, at)
                    key, ids = ids_of(payload, wide)
                    keys.append(None if key == NULL_KEY else key)
                    places.append(at)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at = after
                n = np.array(sizes, np.int64)
                columns = [pa.array([task << 32 | nth] * len(n), pa.int64()), pa.array([name] * len(n), pa.string()), pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(n), pa.array(np.cumsum(n) - n), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "key", "offset", "n_tokens", "before", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(run, "part long, shard string, key long, offset long, n_tokens long, before long, ids_crc32 long")
    return written(found, f"{out}-index")


def read_some(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """Records of the index rows `wanted` (shard, offset, ...), with place from an optional column of that name: key, ids, place.

    For a shuffled read, give wanted = index.withColumn("place", F.rand(seed)) or a sample of it, and sort by place.
    """
    small_batches(spark)
    wide = spark.read.schema("wide boolean").json(f"{out}-format").head()[0]
    if "place" not in wanted.columns:
        wanted = wanted.withColumn("place", F.lit(0.0))
    places = wanted.groupBy("shard").agg(F.collect_list(F.struct("offset", F.col("place").cast("double").alias("place"))).alias("at"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")

    def run(batches):
        for batch in batches:
            for data, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data, rows = data.as_buffer().to_pybytes(), []
                for x in at:
                    key, ids = ids_of(unframe(data, x["offset"])[0], wide)
                    rows.append((None if key == NULL_KEY else key, ids.astype(np.int64).tolist(), x["place"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.float64()), strict=True)], names=["key", "ids", "place"])

    return files.join(places, "shard").select("content", "at").mapInArrow(run, "key long, ids array<long>, place double")


def starts(rows: DataFrame) -> DataFrame:
    """Index rows with `start`, the ids of all rows before, in the order of shards and of records in them."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # shards in runs by their numbers: sums inside a run, and of all runs before it
    run = F.shiftright("part", 32) - F.pmod(F.shiftright("part", 32), F.lit(SUMMED))
    sums = sums.withColumn("run", run)
    inside = sums.withColumn("inside", F.sum("n").over(Window.partitionBy("run").orderBy("part")) - F.col("n"))
    runs = sums.groupBy("run").agg(F.sum("n").alias("n"))
    runs = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("ahead"))
    begin = inside.join(runs, "run").select("part", (F.col("inside") + F.col("ahead")).alias("begin"))
    return rows.join(begin, "part").select("key", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def digests(df: DataFrame, path: str, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write all rows, read the files back, and return per row: key, start, n_tokens, ids_crc32."""
    spark = df.sparkSession
    out = scratch(spark)
    write(df, out, path, end_id, text, key)
    return starts(index(spark, out)).withColumnRenamed("key", key)
