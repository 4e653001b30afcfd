"""Operator 2, language identification by cross-parsing entropy over suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is cross-parsed against it:
from the place reached, follow the automaton as long as what was read occurs in the sample (the longest match), count a
phrase, go on behind it. The fewer phrases a byte of text needs, the closer it is to the sample; the language that needs
the fewest wins. Since only the longest match from a place matters, the automaton with a transition to the root's
successor where a match ends (and that transition marked as a phrase) is a deterministic transducer in one flat table,
and many texts step through it at once in numpy.

Texts are parsed whole. Blocks of BLOCK bytes are stepped through side by side, each from the root; then blocks whose
predecessor ended in another state than they began with are parsed again from that state, until none is left, so the phrases
are those of one parse from the first byte to the last. Letters are lower-cased; ASCII characters that are not letters count
as one separator.

Learning takes at most SAMPLE_ROWS rows a language (those with the smallest hash of key and text) and SAMPLE_BYTES bytes a
language: each row gives an equal share from its middle, and what short rows leave goes to the longer ones. Both are
parameters. Everything else covers all data.

Defined cases: a text that is null, empty or without a letter is `und` with score 0, and nothing is learned from it; ties go
to the language that sorts first; without any labelled row everything is `und`; with one learned language the score is 1;
equal texts give equal rows; rows that repeat key, label and text count once in learning, rows that repeat the key alone are
rows of their own; bytes that no sample holds end a phrase; a very long text is parsed like any other, as blocks; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .bpe import groups
from .common import KEPT, arrow_rows, as_bytes

SAMPLE_ROWS, SAMPLE_BYTES = 64, 16_000
BLOCK = 1024
#: Buckets of a language's rows, of which each gives its first rows to the choice.
BUCKETS = 64
UND = "und"
#: Classes of bytes: padding changes nothing, an unknown byte ends a phrase.
PAD, UNKNOWN, SEPARATOR = 0, 1, 2
has_letter = regex.compile(r"\p{L}").search


def prepare(text: bytes) -> bytes:
    """Lower case, and one separator for runs of ASCII that are not letters."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return low.translate(SEPARATORS)


SEPARATORS = bytes(32 if b < 128 and not 97 <= b <= 122 else b for b in range(256))


def byte_classes(samples: list[bytes]) -> np.ndarray:
    """Class of each byte: each that the samples hold has its own, the rest are unknown to all of them."""
    held = np.zeros(256, bool)
    held[np.frombuffer(b"".join(samples), np.uint8)] = True
    held[32] = False
    out = np.full(256, UNKNOWN, np.uint8)
    out[32] = SEPARATOR
    out[held] = np.arange(SEPARATOR + 1, SEPARATOR + 1 + held.sum())
    return out


def automaton(sample: np.ndarray) -> tuple[list[dict[int, int]], list[int]]:
    """Suffix automaton of a sequence of classes: transitions of each state, suffix links. State 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step, link


def transducer(sample: bytes, classes: np.ndarray) -> np.ndarray:
    """Flat table: at state * width + class, twice the next state, plus one where a phrase ends before this byte."""
    width = int(classes.max()) + 1
    step, _ = automaton(classes[np.frombuffer(sample, np.uint8)])
    # one state more for "behind an unknown byte", which is a phrase of its own
    after = len(step)
    table = np.full((after + 1, width), after * 2 + 1, np.uint16 if after < 2**15 else np.uint32)
    for c, to in step[0].items():
        table[:, c] = to * 2 + 1
    for s, moves in enumerate(step):
        for c, to in moves.items():
            table[s, c] = to * 2
    # at the root nothing has been read yet, so no phrase ends; what the sample lacks is there like an unknown byte
    table[0] &= ~table.dtype.type(1)
    table[:, PAD] = np.arange(after + 1) * 2
    return table.ravel()


def phrases(texts: list[bytes], tables: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Phrases of each prepared text in each language; shape (texts, languages)."""
    sizes, width = np.fromiter(map(len, texts), np.int64, len(texts)), int(classes.max()) + 1
    data = classes[np.frombuffer(b"".join(texts), np.uint8)]
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start, size = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK, np.minimum(BLOCK, sizes[owner] - nth * BLOCK)

    def parse(table: np.ndarray, some: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and phrases ended of these blocks from these entry states."""
        order = np.argsort(-size[some], kind="stable")
        at, long_, state, count = start[some][order], size[some][order], entry[order], np.zeros(len(some), np.int64)
        active = len(at) - np.searchsorted(long_[::-1], np.arange(long_[0] if len(at) else 0), "right")
        for t, n in enumerate(active):
            got = table.take(state[:n] * width + data[at[:n] + t])
            count[:n] += got & 1
            state[:n] = got >> 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    out = np.zeros((len(texts), len(tables)), np.int64)
    for k, table in enumerate(tables):
        entry = np.zeros(len(owner), np.int64)
        leave, count = parse(table, np.arange(len(owner)), entry)
        while True:
            before = np.where(nth > 0, np.concatenate([[0], leave[:-1]]) if len(leave) else leave, 0)
            again = np.flatnonzero(before != entry)
            if not len(again):
                break
            entry[again] = before[again]
            leave[again], count[again] = parse(table, again, entry[again])
        # the phrase that is open at a text's end counts
        out[:, k] = np.bincount(owner, count, len(texts)) + (sizes > 0)
    return out


class Model:
    """Learned languages: name and sample of each."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        self.classes = byte_classes([samples[n] for n in self.names])
        self.tables = [transducer(samples[n], self.classes) for n in self.names]

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.names and has_letter(t.decode("utf-8", "replace"))]
        if known:
            found = phrases([prepare(texts[i]) for i in known], self.tables, self.classes)
            order = np.argsort(found, 1, kind="stable")
            best = np.take_along_axis(found, order, 1)
            for i, o, b in zip(known, order, best, strict=True):
                names[i] = self.names[o[0]]
                scores[i] = 1.0 if len(b) == 1 else float(1 - b[0] / b[1])
        return names, scores


_models: dict[tuple, Model] = {}
KEPT.append(_models.clear)


def _model(samples: tuple[tuple[str, bytes], ...]) -> Model:
    if samples not in _models:
        _models.clear()
        _models[samples] = Model(dict(samples))
    return _models[samples]


def shared(sizes: list[int], most: int) -> list[int]:
    """How much of each to take, so that all get the same, as far as they have it, and the sum is at most `most`."""
    out, left = [0] * len(sizes), most
    for n, i in enumerate(sorted(range(len(sizes)), key=lambda i: sizes[i])):
        out[i] = min(sizes[i], left // (len(sizes) - n))
        left -= out[i]
    return out


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[tuple[str, bytes], ...]:
    """Samples of each language from rows with a label and a letter: at most `rows` rows and `size` bytes each.

    Only hashes and labels are sorted; of the chosen rows, at most `size` characters come to the driver.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    labelled = labelled.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    by = Window.partitionBy("l").orderBy("h")
    # rows that repeat key and text are one; of each task's rest only `rows` rows a language are sorted
    # and then of each bucket, so that one task sees as many for a language as there are buckets, however many tasks there were
    bucket = Window.partitionBy("l", F.pmod(F.xxhash64("h"), F.lit(BUCKETS))).orderBy("h")
    few = labelled.select("l", "h").distinct().withColumn("n", F.row_number().over(bucket)).where(F.col("n") <= rows).select("l", "h")
    chosen = few.withColumn("n", F.row_number().over(by)).where(F.col("n") <= rows).select("l", "h")
    part = F.expr(f"substring(t, greatest(1, cast(length(t) / 2 as int) - {size // 2}), {size})")
    # at most `rows` rows a language are broadcast; a middle part of each chosen row, as labelled text for learning only
    got = labelled.join(F.broadcast(chosen), ["l", "h"]).groupBy("l", "h").agg(F.min(part).alias("part")).collect()
    out: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["l"], r["h"])):
        out.setdefault(r["l"], []).append(prepare(r["part"].encode()))
    taken = {k: [p[(len(p) - n) // 2 :][:n] for p, n in zip(v, shared(list(map(len, v)), size - len(v)), strict=True)] for k, v in out.items()}
    return tuple((k, b" ".join(v)) for k, v in sorted(taken.items()))


def predict(df: DataFrame, samples: tuple[tuple[str, bytes], ...], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred, score of every row."""
    schema = StructType([*(df.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(samples)
        names, scores = [], []
        for some in groups(as_bytes(batch.column(len(keep))), 8_000_000):
            n, s = model.predict(some)
            names += n
            scores += s
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return arrow_rows(df.select(*keep, text), run, schema)


def held_out(key: str = "doc_id"):
    """Rows that learning never sees: crc32 of the key as text is divisible by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def identify(df: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, predict every row: doc_id, held_out, lang_pred, score."""
    samples = learn(df.where(~held_out()))
    return predict(df.withColumn("held_out", held_out()), samples, keep=("doc_id", "held_out"))
