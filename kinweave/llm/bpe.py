"""Operator 4, BPE encoding and decoding: contiguous rank arrays per short word.

A text is normalised and split into words as the tokenizer's file says; each distinct word is merged once
(merging.PairMerger) and then looked up. The memory of words is bounded, which changes no result.

Defined cases: a null text counts as empty and has no ids; an empty text decodes to the empty string; the strings of
special tokens inside a text become those tokens, as the library does by default; equal texts give equal rows; an empty
table gives an empty result; other columns of the input are kept if asked for and never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import KEPT, arrow_rows, as_bytes, spread
from .merging import PairMerger

#: Entries of a generation of a worker's memory of words.
WORDS = 300_000
#: Characters beyond Latin: Python's Unicode tables may be of another version than the tokenizer's, so its own rules split these.
beyond = re.compile("[^\\x00-\\u024f]").search
#: The splitting pattern that latin_words stands for, and the same for lower-case text without characters beyond Latin.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, DIGITS = "a-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
latin_words = re.compile(rf"[{LETTERS}]+|[{DIGITS}]|'s|'t|'re|'ve|'m|'ll|'d|[^{LETTERS}{DIGITS}\t-\r \x85\xa0]+").findall
#: The same for ASCII.
ascii_words = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9\t-\r ]+").findall


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class WordBPE:
    """A tokenizer file of kind BPE with word ends, NFC and lower case, as tokenizers reads it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        if [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"] != [PATTERN]:
            raise ValueError(f"{path} splits words by another pattern")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.special_start = os.path.commonprefix(list(self.special))  # a plain search for this comes first
        self.may_be_special = re.compile("|".join(map(re.escape, self.special))).search
        letters = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        rules = Tokenizer.from_file(path)
        self.normalise, self.cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + suffix] for c in letters]
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.merger = PairMerger(pairs)
        self.known = Memory(self.encode_words, WORDS)

    def words(self, text: str) -> list[str | int]:
        """Words of a text, and ids of special tokens in it."""
        if self.special_start in text and self.may_be_special(text):
            return [w for part in self.specials(text) for w in ((self.special[part],) if part in self.special else self.words(part))]
        if text.isascii():
            return ascii_words(text.lower())
        if beyond(text):
            return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.cut(self.normalise(text))]
        # case goes one character at a time, as no sigma is here; composed forms may lie beyond Latin
        text = unicodedata.normalize("NFC", text)
        return latin_words(text.lower()) if not beyond(text) else [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.cut(self.normalise(text))]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        inner, final = self.inner, self.final
        coded = [w.encode() for w in words]
        return self.merger.merge([[*(inner[b] for b in w[:-1]), final[w[-1]]] for w in coded])

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        words = self.words(text or "")
        ids = dict(zip(some := list({w for w in words if type(w) is str}), self.encode_words(some), strict=True))
        return [i for w in words for i in (ids[w] if type(w) is str else (w,))]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens, joined by spaces."""
        return " ".join(self.tokens[i] for i in ids)


class Memory(dict):
    """Keys that a worker has met, with what `make` gave for them.

    Two generations of at most `limit` entries each: what is still in use moves to the young one, the rest goes when that
    is full. This bounds memory and changes no result.
    """

    def __init__(self, make, limit: int = WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def learn(self, pieces: list) -> None:
        """Afterwards all keys of these lists are here."""
        pieces = set().union(*pieces)
        new = {p for p in pieces if p not in self}
        if len(self) + len(new) > self.limit:
            self.old = dict(self.items())
            self.clear()
            new = pieces
        old = self.old
        self.update({p: old[p] for p in new if p in old})
        new = [p for p in new if p not in old]
        for lo in range(0, len(new), 50_000):
            some = new[lo : lo + 50_000]
            self.update(zip(some, self.make(some), strict=True))


@lru_cache(maxsize=4)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def with_special(model: WordBPE, make):
    """`make` over words, for words and ids of special tokens alike."""

    def both(keys: list) -> list:
        words = [k for k in keys if type(k) is str]
        found = dict(zip(words, make(model.encode_words(words)), strict=True))
        found |= dict(zip(special := [k for k in keys if type(k) is int], make([[k] for k in special]), strict=True))
        return [found[k] for k in keys]

    return both


@lru_cache(maxsize=2)
def _digests(path: str) -> Memory:
    model = load(path)
    return Memory(with_special(model, lambda many: [(len(ids), " ".join(map(str, ids)), model.decode(ids)) for ids in many]))


@lru_cache(maxsize=2)
def _ids(path: str) -> Memory:
    return Memory(with_special(load(path), lambda many: [array("i", ids).tobytes() for ids in many]))


KEPT.extend(f.cache_clear for f in (load, _digests, _ids))


def groups(texts: list[bytes], most: int = 4_000_000):
    """Texts in runs of about `most` bytes, so that what one step holds is bounded by that or by one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """`keep`, ids array<int> and, if asked for, the decoded string of every row: the operator's general form."""
    types = dict(df.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, memory = load(path), _ids(path)
        rows: list[bytes] = []
        for some in groups(as_bytes(batch.column(len(keep)))):
            split = [model.words(t.decode("utf-8", "replace")) for t in some]
            memory.learn(split)
            rows += [b"".join(map(memory.__getitem__, ws)) for ws in split]
        ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
        flat = pa.array(np.frombuffer(b"".join(rows), np.int32))
        out = [*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
        if decoded:
            out.append(pa.array([model.decode(r) for r in out[-1].to_pylist()], pa.string()))
        return pa.RecordBatch.from_arrays(out, names=[*keep, "ids", *["decoded"] * decoded])

    return arrow_rows(spread(df.select(*keep, text)), run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "ids array<int>", *["decoded string"] * decoded]))


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256 of the decoded text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, memory = load(path), _digests(path)
        n_tokens, of_ids, of_text = [], [], []
        for some in groups(as_bytes(batch.column(1))):
            split = [model.words(t.decode("utf-8", "replace")) for t in some]
            memory.learn(split)
            for ws in split:
                n, ids, text = zip(*map(memory.__getitem__, ws), strict=True) if ws else ((), (), ())
                n_tokens.append(sum(n))
                of_ids.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                of_text.append(hashlib.sha256(" ".join(text).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n_tokens, np.int64)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_rows(spread(df.select(key, text)), run, f"`{key}` {dict(df.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
