"""The text operators against libraries and brute force, on small tables with every awkward case."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinweave.llm import bpe, decontaminate, language_id, queries, sharding, simhash, suffix_dedup, suffix_sort, token_counts, token_records, topk_search, warc
from kinweave.llm.common import Tables, durable, lean, scratch, small_batches

WORDS, PIECES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "a", "The cat's it's I'LL 'tis ''s", "<|endoftext|>", "a<|endoftext|>b <|STARTOFTEXT|>", "x" * 3000, "thé CAFÉ ΣΑΣ σς İstanbul ǅ J̌",
    "漢字かな 한국어 😀😀 é", "½²³ 1234 ٣ Ⅷ", "\x00\x01\x1c\x1f\x85    end", "▁▁ under ▁ score", "  two  spaces   ", "a.b,c!?--", "word " * 2000, "thhe" * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(ODD)] + [(100, "same text twice", "en", None, 15), (101, "same text twice", None, "src0", 15)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def empty(spark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)


def random_texts(n, seed=0):
    rng = random.Random(seed)
    letters = "aAbBéÉßΣσςİıǰ̌ \t\n\x0b\x1c\x85　'’.,<|>09²½Ⅷ漢😀ﬁ▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


# --- tokens


def test_bpe_is_the_librarys():
    model, library = bpe.load(WORDS), Tokenizer.from_file(WORDS)
    for text in [t or "" for t in ODD] + random_texts(400):
        want = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == want, text
        assert model.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    model = bpe.load(WORDS)
    rng = random.Random(1)
    for n in (2, 3, 20, 48, 49, 300):
        word = [rng.choice(model.inner[97:105]) for _ in range(n)]
        assert model.merger.merge([word])[0] == model.merger.merge_long(word)


def test_bpe_digests_and_encode(spark, docs):
    library = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in bpe.digests(docs, WORDS).collect()}
    ids = {r["doc_id"]: r for r in bpe.encode(docs, WORDS, keep=("doc_id", "source")).collect()}
    for r in docs.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        mine = got[r["doc_id"]]
        assert ids[r["doc_id"]]["ids"] == want and mine["n_tokens"] == len(want)
        assert ids[r["doc_id"]]["decoded"] == library.decode(want, skip_special_tokens=False)
        assert mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty(spark), WORDS).count() == 0


def test_memory_is_bounded():
    memory = bpe.Memory(lambda keys: [k.upper() for k in keys], limit=3)
    for some in (["a", "b"], ["c", "d"], ["a", "e", "f"], ["g"]):
        memory.learn([some])
        assert [memory[k] for k in some] == [k.upper() for k in some]
        assert len(memory) <= 4 and len(memory.old) <= 4


@pytest.mark.parametrize("chunk", [1, 5, 64, 65_536])
def test_token_counts_are_the_librarys(chunk):
    counter, library = token_counts.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [t or "" for t in ODD if chunk > 4 or len(t or "") < 99] + random_texts(150, chunk):
        assert counter.count(text.encode(), chunk) == len(library.encode(text)), text


def test_token_counts_with_little_memory():
    """Tables and memories that turn over all the time, several chunks a text, no space over a production chunk."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for t in ODD] + random_texts(60, 9) + ["漢字かな" * 40, "a▁b" * 99]
    want = [len(library.encode(t)) for t in texts]
    for states, remembered in ((5, 3), (40, 50), (1000, 300)):
        small = token_counts.PieceCounter(PIECES, states, remembered)
        for chunk in (7, 50, 65_536):
            assert small.count_all([t.encode() for t in texts], chunk) == want
        assert len(small.transducer.states) <= states
    long = "字漢x" * 40_000
    assert token_counts.load(PIECES).count(long.encode()) == len(library.encode(long))


def test_transitions_are_compiled():
    """Every prefix's count is the sum of the transitions' annotations."""
    counter, library = token_counts.PieceCounter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "▁the▁unbelievable▁thheses\n漢😀▁x"
    state = token_counts.INITIAL
    total = 0
    for i, c in enumerate(text):
        added, state = counter.transducer.read(c, state)
        total += added
        assert total == len(library.encode(text[1 : i + 1].replace("▁", " "))) or i == 0
    assert sum(map(len, counter.transducer.table)) >= len(set(text))


def test_token_counts_query(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in token_counts.count_tokens(docs, PIECES, limit=100).join(docs, "doc_id").collect():
        n = len(library.encode(r["text"] or ""))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 100, len((r["text"] or "").encode()))
    assert token_counts.count_tokens(empty(spark), PIECES, 4096).count() == 0


def test_records_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(token_records, "SHARD_BYTES", 4000)
    library = Tokenizer.from_file(WORDS)
    out = scratch(spark)
    token_records.write(docs, out, WORDS, 1)
    index = token_records.index(spark, out)
    assert index.select("shard").distinct().count() > 1
    want, at = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    got = {r["key"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_records.starts(index).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    some = index.where("key % 2 = 0").withColumn("place", F.rand(7))
    read = token_records.read_some(spark, out, some).orderBy("place").collect()
    assert {r["key"]: r["ids"] for r in read} == {k: v[3] for k, v in want.items() if k % 2 == 0}
    assert token_records.digests(empty(spark), WORDS).count() == 0


def test_words_of_records_are_not_split_again():
    """Words come normalised and split: what a worker remembers is made without the tokenizer's normaliser and pattern, with the same ids."""
    rng = random.Random(21)
    texts = [t for t in ODD if t] + ["".join(rng.choices([*map(chr, range(128)), "é", "ſ", "ß", "İ", "漢", "'s", "'LL", " "], k=300)) for _ in range(200)]
    library, splitter, memory = Tokenizer.from_file(WORDS), bpe.load(WORDS), token_records._memory(WORDS)
    split = [splitter.words(t) for t in texts]
    memory.learn(split)
    for t, ws in zip(texts, split, strict=True):
        assert np.frombuffer(b"".join(memory[w] for w in ws), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    make = dict(zip(memory.make.__code__.co_freevars, (c.cell_contents for c in memory.make.__closure__), strict=True))
    assert make["model"].normalizer is None


def test_ascii_words_are_the_latin_ones():
    rng = random.Random(22)
    for _ in range(2000):
        text = "".join(rng.choices([*map(chr, range(128)), "'s", "'re", "'ll", "'v", "''", "the"], k=40)).lower()
        assert bpe.ascii_words(text) == bpe.latin_words(text)


def test_shard_numbers_are_not_read_from_the_uuid():
    for name in ("part-00002-1b9d6bcd-c123-4b2d-9b5d-ab8dfbbd4bed-c007.txt", "part-00002-1b9d6bcd-bbfd-c1d4-c5b5-ab8dfbbd4bed-c007"):
        assert tuple(map(int, token_records.file_name(name).groups())) == (2, 7)


def test_records_with_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, "b"), (3, "x"), (3, "x"), (3, "a b")], "doc_id long, text string")
    got = [tuple(r) for r in token_records.digests(df, WORDS).orderBy("start").collect()]
    # equal keys in the order of the scan
    assert [g[0] for g in got] == [None, 3, 3, 3] and [g[2] for g in got] == [2, 2, 2, 3] and [g[1] for g in got] == [0, 2, 4, 6]


def test_shards_are_ordered_by_number_and_bounded_by_bytes(spark, monkeypatch):
    """One large text among small ones, and shard numbers that sort otherwise as text."""
    monkeypatch.setattr(token_records, "SHARD_BYTES", 3000)
    df = spark.createDataFrame([(i, "word " * (5000 if i == 3 else 50)) for i in range(200)], "doc_id long, text string").repartition(3)
    out = scratch(spark)
    token_records.write(df, out, WORDS, 1)
    index = token_records.index(spark, out)
    sizes = index.groupBy("shard").agg(F.max("offset").alias("last"), F.count("*").alias("n")).collect()
    assert len(sizes) > 5 and all(r["last"] < 3000 for r in sizes)
    rows = spark.createDataFrame([(p << 32 | c, f"part-{p}", 10 * p + c, 0, p + c + 1, 0, 0) for p in (9, 99_999, 100_000, 1_000_000) for c in (0, 2, 11)], "part long, shard string, key long, offset long, n_tokens long, before long, ids_crc32 long")
    monkeypatch.setattr(token_records, "SUMMED", 7)
    got, at = {r["key"]: r["start"] for r in token_records.starts(rows).collect()}, 0
    for r in rows.orderBy("part").collect():
        assert got[r["key"]] == at
        at += r["n_tokens"]


def test_damage_is_found():
    data = token_records.frame(b"hello") + b"\n"
    assert bytes(token_records.unframe(data)[0]) == b"hello"
    for i in range(len(data) - 1):
        with pytest.raises(ValueError, match="record at"):
            token_records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])


# --- languages


def test_automaton_phrases_are_greedy_longest_matches():
    rng = random.Random(3)
    for _ in range(60):
        sample = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))).encode()
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60))).encode()
        classes = language_id.byte_classes([sample])
        got = language_id.phrases([text], [language_id.transducer(sample, classes)], classes)[0, 0]
        at = n = 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in sample and text[at : at + k] in sample:
                k += 1
            at += k
            n += 1
        assert got == n


def test_phrases_cross_blocks(monkeypatch):
    rng = random.Random(13)
    samples = ["".join(rng.choice("ab c") for _ in range(60)).encode() for _ in range(2)]
    texts = ["".join(rng.choice("ab cd") for _ in range(n)).encode() for n in (0, 1, 6, 7, 8, 50, 400)]
    classes = language_id.byte_classes(samples)
    tables = [language_id.transducer(s, classes) for s in samples]
    whole = language_id.phrases(texts, tables, classes)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert (language_id.phrases(texts, tables, classes) == whole).all()


def test_learning_from_repeated_rows(spark):
    rows = [(1, "the cat", "en"), (1, None, "en"), (1, "the cat", "en"), (1, "the dog", "en"), (2, "der hund", "de"), (None, "le chat", "fr"), (None, None, None), (3, "12", "xx")]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    got = dict(language_id.learn(df))
    assert sorted(got) == ["de", "en", "fr"] and sorted(got["en"].split(b" ")) == [b"cat", b"dog", b"the", b"the"]
    assert language_id.shared([1, 100, 5, 100], 50) == [1, 22, 5, 22]
    long = spark.createDataFrame([(i, "abc " * 9000, "en") for i in range(3)] + [(9, "kurz", "de")], df.schema)
    assert {k: 0 < len(v) <= 16_000 for k, v in language_id.learn(long)} == {"de": True, "en": True} and len(dict(language_id.learn(long))["en"]) > 15_000
    assert language_id.identify(df).count() == len(rows) * 3


def test_language_of_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score"), F.max("score"), F.count("*")).head()
    assert r["a"] > 0.95 and 0 <= r[1] <= r[2] <= 1 and 100 < r[3] < 300
    assert got.count() == df.count()


def test_language_edges(spark, docs):
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == docs.count()
    for i, t in enumerate(ODD):
        blank = not any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (blank or got[i]["score"] == 0 and blank), t
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language_id.identify(empty(spark)).count() == 0


# --- search


def test_search_is_exact(spark):
    rng = np.random.default_rng(0)
    vectors = [rng.normal(size=16).round(2).tolist() for _ in range(300)]
    vectors[7], vectors[50] = vectors[8], vectors[100]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (950, [1.0, None] + [0.0] * 14), (1000, [float("nan")] * 16), (1050, []), (1100, [1.0, 2.0]), (1150, [3.0, 1.0]), (1200, [1e30] * 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in topk_search.top5(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v is not None and all(x is not None and x == x for x in v)}
    for q in (i for i in whole if i % 50 == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want = [(k + 1, i, min(-s, 2**63 - 1)) for k, (s, i) in enumerate(found)]
        assert sorted(got.get(q, [])) == want
    assert topk_search.top5(df.limit(0)).count() == 0


def test_search_of_any_finite_vectors(spark):
    """Components up to the largest float and double, long scores at their limits, repeated ids, null ids, other names, lengths."""
    big = 1.7e308
    vectors = [[3e38, -3e38], [big, big], [-big, 1.0], [1e12, 1e12], [1e12, -1.0], [2.0**27 + 1, 2.0**27], [1.0, 2.0], [0.5, 0.25], [2.0**46, 0.0], [2.0**46 - 1, 0.0], [1e30, 1e30], [5e-324, -5e-324], [0.0, 0.0]]
    rows = [(50 * i, v) for i, v in enumerate(vectors)] + [(50 * i + 1, v) for i, v in enumerate(vectors)]
    rows += [(7, [1.0]), (100, [9.0]), (8, [4.0]), (8, [4.0]), (None, [1.0, 2.0]), (None, [9.0])]
    for vectors_of in (lambda v: v, lambda v: [float(np.clip(np.float32(min(max(x, -3e38), 3e38)), -3.4e38, 3.4e38)) for x in v]):
        kind = "double" if vectors_of([big])[0] == big else "float"
        data = [(i, vectors_of(v)) for i, v in rows]
        df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").withColumn("id", F.lit("x")).withColumn("v", F.lit(0)).withColumn("cell", F.lit(1)).repartition(3)
        whole = [(i, [int(np.floor(256 * x)) if abs(x) < 1e9 else int(x) * 256 for x in map(float, v)]) for i, v in data if i is not None]
        got = {}
        for r in topk_search.top5(df).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        asked = sorted({i for i, _ in whole if i % 50 == 0})
        for q in asked:
            found = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for j, x in whole if j == q for i, v in whole if i != q and len(v) == len(x))[:5]
            assert sorted(got.get(q, [])) == [(n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(found)], (kind, q)


def test_order_of_scores_beyond_long():
    scores = [s * x for x in (0, 1, 2**62, 2**63 - 1, 2**63, 2**63 + 1, 2**64, 2**200, 2**200 + 1, 2**1000) for s in (1, -1)]
    held = lambda x: (min(max(x, topk_search.LEAST), topk_search.MOST), topk_search.beyond_long(x), x)
    assert [x for _, _, x in sorted(map(held, scores))] == sorted(scores)


def test_search_in_blocks(spark):
    df = topk_search.integer_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"))
    q = df.where("id % 50 = 0")
    one = sorted(map(tuple, topk_search.search(q, df).collect()))
    assert sorted(map(tuple, topk_search.search(q, df, block=3).collect())) == one


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 64)), rng.normal(size=(30, 64))
    exact, before = x @ y.T, np.inf
    for level in topk_search.LEVELS:
        bound = topk_search.segment_stats(x, level) @ topk_search.segment_stats(y, level).T
        assert (bound >= exact - 1e-9).all() and (bound <= before + 1e-9).all()
        before = bound


# --- archives


def test_archives(spark):
    rows = [(1, "http://a/ x\n", "same"), (2, "http://b", "same"), (9, None, "same"), (4, "u", None), (5, "v", ""), (6, "w", "WARC/1.1\r\n\r\nfoo\r\n\r\n"), (7, "z", "é" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warc.digests(df).collect()}
    want = {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 4: ("revisit", 5), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == want
    for k, _, t in rows:
        data = (t or "").encode()
        assert got[k]["payload_bytes"] == len(data) and got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    least = {r["page_id"]: r["record_type"] for r in warc.digests(df, least=1).collect()}
    assert least[4] == least[5] == "response" and least[1] == "revisit"
    assert warc.digests(df.limit(0)).count() == 0


def test_archive_records_and_captures(spark):
    out = scratch(spark)
    warc.write(spark.createDataFrame([(1, "http://a", "foo"), (2, "http://b", "foo"), (2, "http://b", "foo")], "page_id long, url string, html string"), out)
    records = warc.read(spark, out)
    assert {r["type"]: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 3, "metadata": 3, "response": 2, "revisit": 1}
    captures = warc.assemble(records).collect()
    assert len(captures) == 3 and all(c["request"]["uri"] == c["response"]["uri"] and c["metadata"]["page"] for c in captures)
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_archives_of_awkward_keys(spark, monkeypatch):
    """Null and repeated keys, hot payloads, clashing columns, payloads beyond an archive's size: one row a page, ids unique."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(None, "u", None), (None, "u", None), (None, "u", "x"), (3, "u", ""), (3, "u", ""), (3, "w", "x"), (1, "u", "x"), (-5, None, "x"), (7, "v", "y" * 9000), (8, "v", "y" * 9000)] + [(100 + i, "v", "error") for i in range(60)] + [(None, "n", "alone"), (None, "n", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k")).withColumn("payload", F.lit(1)).withColumn("sha1", F.lit(2)).withColumn("number", F.lit(3))
    df = durable(df.repartition(3))
    got = sorted((tuple(r)[:2] + tuple(r)[3:] for r in warc.digests(df).collect()), key=repr)
    want = []
    for k, _, t in rows:
        same = [j for j, _, x in rows if (x or "") == (t or "")]
        main = max((j for j in same if j is not None), default=None)
        revisit = len(same) > 1 and main is not None and k != main
        want.append((k, len((t or "").encode()), "revisit" if revisit else "response", main if revisit else None))
    assert got == sorted(want, key=repr)
    out = scratch(spark)
    warc.write(df, out)
    records = warc.read(spark, out)
    assert records.select("id").distinct().count() == records.count() == 3 * len(rows)
    ids = {r["id"] for r in records.where("type = 'response'").collect()}
    assert {r["refers_to"] for r in records.where("type = 'revisit'").collect()} <= ids


# --- shards


def brute_shards(rows, shards):
    """doc_id -> (size, shard, slot) of rows (doc_id, text): shares by bytes, small groups of equal texts kept together."""
    key = lambda r: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0])
    rows = sorted(rows, key=key)
    sizes = [len((t or "").encode()) + 8 for _, t in rows]
    total, before = sum(sizes), [0, *np.cumsum(sizes).tolist()]
    cuts = []
    for i in range(1, shards):
        target = -(-total * i // shards)
        at = next((k for k in range(len(rows)) if before[k] >= target), len(rows))
        if 0 < at < len(rows) and key(rows[at])[0] == key(rows[at - 1])[0]:
            low = next(k for k in range(at + 1) if key(rows[k])[0] == key(rows[at])[0])
            high = next((k for k in range(at, len(rows)) if key(rows[k])[0] != key(rows[at])[0]), len(rows))
            if before[high] - before[low] <= total // (shards * sharding.TOLERANCE):
                at = low if target - before[low] <= before[high] - target else high
        cuts.append(at)
    out = {}
    for k, (doc_id, _) in enumerate(rows):
        shard = sum(c <= k for c in cuts)
        out[doc_id] = (sizes[k], shard, k - (cuts[shard - 1] if shard else 0))
    return out


@pytest.mark.parametrize(("shards", "tolerance"), [(1, 100), (5, 1), (24, 100), (24, 1)])
def test_shards(spark, docs, shards, tolerance, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 30)
    monkeypatch.setattr(sharding, "TOLERANCE", tolerance)
    more = [(500 + i, "hot " * 20, "en", "s", 80) for i in range(60)] + [(600 + i, f"group {i // 7}", "en", "s", 7) for i in range(70)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute_shards(rows, shards)
    got = {r["doc_id"]: r for r in sharding.shard(df, shards).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r["size"], r["shard"], r["slot"]) == want[doc_id] and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["text_crc32"] == zlib.crc32((text or "").encode())
    assert sharding.shard(empty(spark), 24).count() == 0


def test_groups_stay_together(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = sharding.shard(df, 24).collect()
    assert {r["doc_id"]: (r["size"], r["shard"], r["slot"]) for r in got} == brute_shards(list(texts.items()), 24)
    share = sum(r["size"] for r in got) / 24
    groups = {}
    for r in got:
        groups.setdefault(texts[r["doc_id"]], []).append(r)
    assert all(len({r["shard"] for r in g}) == 1 for g in groups.values() if sum(r["size"] for r in g) <= share // 100)


def test_shards_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 10 + [(None, "a")] * 3, "doc_id long, text string")
    got = sharding.shard(df, 4).collect()
    assert len(got) == 13
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


# --- benchmark leaks


def brute_leaks(docs, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for d, t in docs:
        w, hit, found = low(t), set(), set()
        for i, x in items:
            v = low(x)
            k = min(10, len(v))
            for a in range(len(v) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[a : a + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("limit", [200_000, 6, 3])
def test_leaks(spark, docs, limit):
    long = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, long), (2, "Same TEXT"), (10, "é É"), (11, None), (12, "..."), (13, long.upper()), (14, "word word word")]
    more = [(200, "x " + long + " y " + long, "en", "s", 0), (201, long[4:], "en", "s", 0), (202, "é é É é", "en", "s", 0), (203, long.replace(" ", "-"), "en", "s", 0)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(df, bench, 10, set_limit=limit)
    got = {r["doc_id"]: r for r in found.collect()}
    want = brute_leaks([(r["doc_id"], r["text"]) for r in df.collect()], items)
    for d, (n, hits, n_items, _, _) in want.items():
        places = {p for h in got[d]["hits"] for p in range(h["at"], h["at"] + h["width"])}
        assert (got[d]["n_words"], len(places), len({h["item"] for h in got[d]["hits"]})) == (n, hits, n_items), d
    kept = decontaminate.clean(df, bench, set_limit=limit)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, w in want.items() if not w[4])
    if limit > 3:
        assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.digests(df, bench).collect()} == want


def test_leaks_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontaminate.digests(docs, none).collect()} == {False}
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.digests(empty(spark), none).count() == 0


def test_leaks_use_no_python(spark):
    plan = decontaminate.digests(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- near copies


def brute_fingerprint(t, words):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < words else [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("words", [4, 5])
def test_fingerprints(words):
    for t in [*ODD, *random_texts(50)]:
        assert simhash.fingerprint((t or "").encode(), words) == brute_fingerprint(t, words), t


def test_bk_trees_find_all_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(0, 60, 7) for j in range(0, 40, 9)]))
    shard = np.repeat(np.arange(2), len(fp))
    forest = simhash.Forest(shard, np.concatenate([fp, fp]))
    got = set()
    for a, b in forest.search(np.arange(2 * len(fp)), 4):
        got |= set(zip(a.tolist(), b.tolist(), strict=True))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i != j}
    assert got == want | {(i + len(fp), j + len(fp)) for i, j in want}


def test_null_keys_link_others(spark, monkeypatch):
    """Fingerprints 0, 0b1111 (of a null key) and 0b11111111 are one chain at radius 4; a component of null keys alone has none."""
    made = spark.createDataFrame([(1, 0), (None, 0b1111), (2, 0b11111111), (None, -1), (None, -2)], "key long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: made)
    got = sorted((r["fp"], r["component_id"]) for r in simhash.cluster(made).collect())
    assert got == [(-2, None), (-1, None), (0, 1), (0b1111, 1), (0b11111111, 1)]


@pytest.mark.parametrize("limit", [8192, 4])
def test_clusters_of_fingerprints(spark, limit):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:20]:
        for _ in range(6):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))
            fps.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    fps = spark.createDataFrame([(f,) for f in signed], "fp long")
    with Tables(spark) as tables:
        of = {r["node"]: r["component"] for r in simhash.components(simhash.links(fps, 4, tables, limit)).collect()}
    # numbered by the first of each component, as brute force does it
    first = {}
    got = {i: first.setdefault(of.get(f, f), i) for i, f in enumerate(signed)}
    u, label = np.array(signed, np.int64).view(np.uint64), list(range(len(signed)))
    near = np.argwhere(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    for _ in range(len(label)):
        now = list(label)
        for a, b in near:
            label[a] = min(label[a], label[b])
        if now == label:
            break
    assert {i: got.get(i, i) for i in range(len(label))} == dict(enumerate(label))


def test_near_copies_query(spark, docs):
    rng = random.Random(5)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.randrange(99)) for _ in range(300))
    more = [(300, text, "en", "s", 0), (301, text, "en", "s", 0), (302, text + " end", "en", "s", 0), (None, text, "en", "s", 0)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = simhash.digests(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == df.count() and {by[i]["component_id"] for i in (300, 301, 302, None)} == {300}
    assert all(by[r["doc_id"]]["fingerprint"] == f"{brute_fingerprint(r['text'], 4):016x}" for r in df.collect())
    assert by[0]["component_id"] == 0 and by[1]["component_id"] == 0 and by[2]["component_id"] == 0
    kept = simhash.keep_one(df)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns and {300, 100} <= ids and not ids & {301, 302, 101, None}
    assert simhash.digests(empty(spark)).count() == 0


# --- repeated strings


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for k in range(400):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 60))).astype(np.uint8) + np.uint8(251 if k % 2 else 0)
        b = t.tobytes()
        want = sorted(range(len(t)), key=lambda i: b[i:])
        sa = suffix_sort.suffix_array(t)
        assert sa.tolist() == want
        if len(t):
            lcp = {want[0]: 0}
            for i, j in zip(want, want[1:], strict=False):
                n = 0
                while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
                    n += 1
                lcp[j] = n
            assert suffix_sort.common_prefixes(t, sa).tolist() == [lcp[i] for i in range(len(t))]


def brute_spans(texts, length=200):
    """Which bytes go, of each text."""
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def brute_repeats(texts, length=200):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 2, np.int8)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        out.append((len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 1])
def test_repeats(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, line = make(700), make(240)
    texts = [make(rng.randrange(400)) + passage[rng.randrange(200) : 400 + rng.randrange(300)] + make(rng.randrange(300)) for _ in range(25)]
    long = make(20_000)
    texts += [long, make(50) + long[9_000:9_400] + make(17_000) + passage[:300], make(40_000)]
    texts += [make(90) + line + make(90) for _ in range(25)] + ["ab" * 150, "z" * 201, "y" * 200, passage, passage, make(199)]
    df = docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], docs.schema))
    rows = df.collect()
    want = dict(zip((r["doc_id"] for r in rows), brute_repeats([(r["text"] or "").encode() for r in rows]), strict=True))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digests(df).collect()}
    assert got == want
    if hot > 1:
        kept = suffix_dedup.clean(df)
        assert kept.columns == df.columns
        after = {r["doc_id"]: r for r in kept.collect()}
        assert len(after) == len(rows) and after[0]["text"] is None
        for r in rows:
            if r["text"] is not None and want[r["doc_id"]][1] == 0:
                assert after[r["doc_id"]]["text"] == r["text"] and after[r["doc_id"]]["n_chars"] == len(r["text"])


def test_repeats_with_repeated_and_null_keys(spark):
    text = "".join(random.Random(7).choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (None, "x" + text), (-5, "short")], "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in suffix_dedup.digests(df).collect()), key=repr)
    assert got == sorted([(1, 300, 300, 1), (1, 300, 300, 1), (None, 301, 300, 1), (-5, 5, 0, 0)], key=repr)
    assert suffix_dedup.digests(empty(spark)).count() == 0


# --- queries and pipeline


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_inputs_with_clashing_columns(spark, docs):
    clash = docs.withColumn("row", F.lit("x")).withColumn("key", F.lit(1)).withColumn("h", F.lit(2)).withColumn("n_tokens", F.lit("t")).withColumn("size", F.lit(0)).withColumn("component_id", F.lit(3)).withColumn("_row", F.lit(4))
    n, bench = docs.count(), spark.createDataFrame([(1, "same text")], "item_id long, text string")
    for made in (token_records.digests(clash, WORDS), language_id.identify(clash), bpe.digests(clash, WORDS), token_counts.count_tokens(clash, PIECES, 9), sharding.shard(clash, 3), decontaminate.digests(clash, bench), simhash.digests(clash), suffix_dedup.digests(clash)):
        assert made.count() == n
    for made in (simhash.keep_one(clash), suffix_dedup.clean(clash), decontaminate.clean(clash, bench)):
        assert made.columns == clash.columns


def test_pipeline(spark, tmp_path):
    """Each stage against its own rule, on planted cases."""
    import corpus_pipeline

    rng = random.Random(8)
    source = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars BETWEEN 600 AND 3000").orderBy("doc_id").limit(12).collect()]
    shared = "".join(rng.choice("abcdefghij ") for _ in range(300))
    leak = "one two three four five six seven eight nine ten eleven"
    texts = [*source, source[0], source[1] + " tail", "12345 !!", None, "Begin " + shared + source[2][:200][::-1], "Other " + shared + source[3][:200][::-1], source[4][::-1] + " " + leak]
    rows = [(i, t, "en" if i != 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"out{k}")
        stage(spark, kept[-1], str(tmp_path)).write.parquet(out)
        kept.append(spark.read.parquet(out))
        assert k == 4 or kept[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    assert ids[0] - ids[1] == {14, 15}
    assert kept[1].where("lang IS NULL").count() == 0
    assert 12 in ids[1] - ids[2] and not (ids[1] - ids[2]) & set(range(12))
    assert ids[3] == ids[2]
    texts3 = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    assert shared not in texts3[16] and shared not in texts3[17]
    assert ids[3] - ids[4] == {18}
    library = Tokenizer.from_file(WORDS)
    final = {r["doc_id"]: r["ids"] for r in kept[5].collect()}
    assert final == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in kept[4].collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[5]


AWKWARD = ("row", "node", "component", "_text", "_doc2", "h", "g", "hot", "shard", "same", "first", "size", "lang_pred", "score", "_row", "key", "n", "src one")


def test_pipeline_is_brute_force(spark, tmp_path):
    """Every stage on all that the one before kept, whole, against plain Python: copies, near copies, repeats, leaks, nulls, other columns."""
    import corpus_pipeline

    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7)))
    make = lambda n: [word() for _ in range(n)]
    shared, leak, texts = " ".join(make(70)), "one two three four five six seven eight nine ten eleven", []
    for n in (3, 9, 40, 120, 300):
        base = make(n)
        near = [w if i % 40 else word() for i, w in enumerate(base)]
        texts += [" ".join(base), " ".join(base), " ".join(near), " ".join(base[: n - n // 5 - 1]), " ".join(base + make(n))]
    texts += [" ".join(make(20)) + shared + " ".join(make(30)) for _ in range(4)] + [leak, " ".join(make(9)) + " " + leak.upper(), shared + " " + leak, "12 !!", "", None, None, " ".join(make(6000)), "ß" * 150 + "x" + "ß" * 150]
    keys = [None if i in (3, 4) else 7 if i in (8, 9) else i for i in range(len(texts))]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s", None]), None if t is None else len(t)) for k, t in zip(keys, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in AWKWARD:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("n_chars").cast("string")))
    items = [(1, leak), (2, None), (3, "..")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = [(r["doc_id"], r["text"]) for r in now.collect()]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append([(r["doc_id"], r["text"]) for r in now.collect()] if k < 4 else sorted(((r["doc_id"], tuple(r["ids"])) for r in now.collect()), key=repr))
        assert k == 4 or now.columns == docs.columns
        if k == 0:
            want = [(i, t) for i, t in want if any(c.isalpha() for c in t or "")]
            assert now.where("lang IS NULL OR lang NOT IN ('en', 'de')").count() == 0
        elif k == 1:
            groups = {}
            for row, label in zip(want, jaccard_components([t for _, t in want]), strict=True):
                groups.setdefault(label, []).append(row)
            # one row of each group: of the smallest key, any of those that share it
            assert len(seen[1]) == len(groups) and 10 < len(groups) < len(want) - 5
            order = lambda row: (row[0] is None, row[0] or 0)
            for g in groups.values():
                assert any(row in seen[1] for row in g if order(row) == min(map(order, g)))
            want = seen[1]
        elif k == 2:
            data = [(t or "").encode() for _, t in want]
            spans = brute_spans(data)
            want = [(i, None if t is None else bytes(x for x, gone in zip(b, s, strict=True) if not gone).decode("utf-8", "ignore")) for (i, t), b, s in zip(want, data, spans, strict=True)]
            assert any(any(s) for s in spans)
        elif k == 3:
            hit = [v[4] for v in brute_leaks(list(enumerate(t for _, t in want)), items).values()]
            want = [x for x, h in zip(want, hit, strict=True) if not h]
            assert any(hit)
        else:
            library = Tokenizer.from_file(WORDS)
            want = [(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in want]
        assert sorted(seen[k], key=repr) == sorted(want, key=repr), corpus_pipeline.STAGES[k][0]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    empty(spark).withColumn("row", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0
    assert now.columns == ["doc_id", "lang", "source", "ids"]


def jaccard_components(texts, words=5, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]) - 1e-9:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


@pytest.mark.parametrize(("limit", "part"), [(1024, 1024), (3, 1024), (1024, 2)])
def test_near_copies_by_jaccard(spark, limit, part, monkeypatch):
    """Copies at similarities about 0.8, with a hot passage in many texts, against brute force; SimHash radius 4 misses most."""
    from kinweave.llm import near_copies

    monkeypatch.setattr(near_copies, "PART_TEXTS", part)
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    hot, texts = " ".join(word() for _ in range(30)), []
    for n in (8, 9, 14, 40, 120, 300):
        for _ in range(4):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base) + " " + hot * rng.randrange(2))
            for changes in (1, max(1, n // 45), max(1, n // 40), n // 10):
                copy = list(base)
                for i in rng.sample(range(n), min(changes, n)):
                    copy[i] = word()
                texts.append(" ".join(copy) + " " + hot * rng.randrange(2))
            texts.append(" ".join(base[: -max(1, n // 6)]))
    texts += [texts[0], None, "", " "]
    want = jaccard_components(texts)
    assert 40 < len(set(want)) < len(texts) - 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in near_copies.keep_one(df, limit=limit).collect())
    assert kept == sorted(set(want))
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_lists_of_shingles_keep_the_order():
    """What a text is dealt by, from its list alone, is the start of all its shingles with hot ones last; else the list has run out."""
    from kinweave.llm import near_copies

    rng = np.random.default_rng(4)
    for least in (50, 80, 100):
        every = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (0, 1, 2, 3, 9, 30, 80, 200) for _ in range(20)]
        hot = np.unique(rng.integers(0, 400, 120).astype(np.uint64))
        for some in (hot, hot[:0]):
            n = np.array([len(x) for x in every])
            most = near_copies.wanted(n, least)
            lists = [x if i % 3 == 0 else x[: k + k // 4] for i, (x, k) in enumerate(zip(every, most.tolist(), strict=True))]
            sizes = np.array([len(x) for x in lists])
            used, spare, out = near_copies.dealt_by(n, sizes, np.concatenate(lists), some, least)
            assert not (used & spare & np.isin(np.concatenate(lists), some)).any() and (not out.any() if not len(some) else out.any())
            for x, part, k, at, ran_out in zip(every, lists, most.tolist(), np.cumsum(sizes) - sizes, out, strict=True):
                late = np.isin(x, some)
                assert ran_out == (len(part) < len(x) and (~np.isin(part, some)).sum() < k)
                if not ran_out:
                    assert sorted(part[used[at : at + len(part)]]) == sorted(np.concatenate([x[~late], x[late]])[:k])


def test_texts_are_read_again_only_where_lists_run_out(spark):
    """A hot line moves to the end without the texts; texts of it mostly are read again, and no others."""
    from kinweave.llm import near_copies

    line = "one very common line that stands in nearly all of these texts"
    lines = lambda n, i: " ".join(f"w{i}x{j}" for j in range(n))
    df = spark.createDataFrame([(i, f"{lines(60, i // 2)} {line}") for i in range(40)], "node long, text string")

    class Unread:
        sparkSession = spark

    with Tables(spark) as tables:
        listed = tables.keep(near_copies.signatures(df, 5, 80).withColumnRenamed("row", "node"))
        got = near_copies.shards(Unread, listed, 5, 80, 10, tables).groupBy("shard").agg(F.collect_set("node").alias("of")).collect()
        assert {tuple(sorted(r["of"])) for r in got} == {(i, i + 1) for i in range(0, 40, 2)}
        few = spark.createDataFrame([(i,) for i in (3, 17, 38)], "node long")
        passed = {r["node"] for r in near_copies.only(df, few).collect()}
        assert {3, 17, 38} <= passed and len(passed) < 20
        assert near_copies.only(df, few.limit(0)).count() == 0
    texts = [f"{lines(4, i // 2)} {line * 3}" if i < 30 else f"{lines(60, i // 2)} {line}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df, limit=10).collect()) == sorted(set(jaccard_components(texts)))


@pytest.mark.parametrize(("limit", "part"), [(1024, 1024), (20, 15)])
def test_one_large_family(spark, limit, part, monkeypatch):
    """120 variants of one text, of which some are alike only through others and some not at all; cut into parts or whole."""
    from kinweave.llm import near_copies

    monkeypatch.setattr(near_copies, "PART_TEXTS", part)
    rng = random.Random(15)
    base, texts = [f"w{rng.randrange(300)}" for _ in range(100)], []
    for _ in range(120):
        copy = list(base)
        for i in rng.sample(range(100), rng.choice((0, 1, 2, 3, 6, 9))):
            copy[i] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy))
    want = jaccard_components(texts)
    assert 10 < len(set(want)) < 110
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df, limit=limit).collect()) == sorted(set(want))
    sets = [near_copies.distinct_hashes(t.encode(), 5) for t in texts]
    u, v = near_copies.forest(np.arange(len(sets)), sets, 80)
    label = list(range(len(sets)))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    assert label == want and len(u) == len(sets) - len(set(want))


def test_one_row_of_each_group_of_copies(spark):
    """Repeated and null doc_ids: exactly one row of each group stays, whatever its id, and none of another group goes."""
    from kinweave.llm import near_copies

    a, b, c, d = random_texts(400, 12)[-4:]
    a, b, c, d = (f"{name} one two three four five six {t}" for name, t in zip("abcd", (a, b, c, d), strict=True))
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (7, c), (8, c), (8, d), (None, d + " "), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("component", F.lit(2)).repartition(3)
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, a), (None, b), (7, c), (8, d)], key=repr)


def test_runs_do_not_depend_on_what_is_found_at_once(monkeypatch):
    """Runs of a few texts at a time are those of all at once, so a small RUN_BYTES changes no result."""
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"ab c", k=rng.choice([0, 150, 200, 700, 3000]))) for _ in range(40)]

    def found(most):
        out, done = [], 0
        for some in bpe.groups(texts, most):
            sizes = np.array([len(t) for t in some])
            text, place, size, h = suffix_dedup.runs(np.frombuffer(b"".join(some), np.uint8), np.cumsum(sizes) - sizes, sizes)
            out += zip((text + done).tolist(), place.tolist(), size.tolist(), h.tolist(), strict=True)
            done += len(some)
        return out

    assert found(1) == found(2500) == found(10**9) and len(found(1)) > 100


def test_tasks_begin_without_what_others_left_in_a_worker(spark):
    """The pipeline: a worker that is used again loses the tables of the language stage and the words of the tokens stage."""
    task = lean(lambda batches: iter(batches))

    def run(batches):
        language_id._model((("de", b"der und die"), ("en", b"the and of")))
        bpe._ids(WORDS)
        held = len(language_id._models) + bpe._ids.cache_info().currsize
        for _ in task(batches):
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([len(language_id._models) + bpe._ids.cache_info().currsize])], names=["held", "left"])

    small_batches(spark)
    assert [tuple(r) for r in spark.range(1).mapInArrow(run, "held long, left long").collect()] == [(2, 0)]
