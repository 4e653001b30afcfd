"""Operator 6, token counts by a compiled finite-state transducer.

A greedy pair merge leaves tokens of which each two neighbours stay apart when merged alone, and each text has one such
sequence (a merge that crosses a boundary would cross it with the two neighbours alone as well). So the last token of a
text's prefix is the one that ends there and stays apart from the last token of what is before it, and the whole follows from
a bounded memory: the places from which a piece of the vocabulary may still be going on. A state holds, for each such place,
the node in the trie of pieces, the last token before it and how many tokens fewer the text had there; nothing else decides
how any text goes on. A transition reads a character and is annotated with the number of tokens that it adds (less than zero
where it joins some). States are finite; Transducer makes them and their transitions when first met and keeps a bounded table.

Where two neighbouring characters stand side by side in no piece, the cut between them is certain, and the state behind it is
the initial one. The map of a chunk from entry state to exit state is therefore a head, the text before its first certain cut,
which any entry state must read, and behind it a constant: tokens and exit state. A chunk without a cut is all head. Maps
compose associatively: the second's head is read from the first's exit state. Long texts are cut into chunks, whose maps are
made apart and composed pair by pair, as in a parallel prefix scan. Segments between cuts are chunks with an empty head; the
counts of short ones are remembered, within a bound.

Defined cases: a null text counts as empty; an empty text has no tokens; a very long text is counted by chunks, and what it
lacks in cuts is read on in one go; strings of special tokens inside a text are ordinary text, as the library has them; equal
texts give equal rows; repeated and null keys are rows of their own; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Memory, groups
from .common import KEPT, arrow_rows, as_bytes, spread
from .merging import PairMerger

#: Bytes of a chunk of a long text.
CHUNK = 65_536
#: States of a worker's table, pairs of tokens that are known to stay apart or not, and segments of at most SHORT bytes that are remembered.
STATES, PAIRS, SEGMENTS, SHORT = 300_000, 1_000_000, 500_000, 48
SPACE, MARK = " ", "▁"

#: One segment between certain cuts: a line feed, or spaces and the text up to the next space or line feed.
segments = re.compile(rb"\n| *[^ \n]+| +").findall
State = tuple[tuple[int, int, int], ...]
#: Head, and behind it tokens and exit state; None if there is no cut.
Map = tuple[bytes, tuple[int, State] | None]

#: No token before a place: the text or what follows a certain cut begins there.
NOTHING = -1
INITIAL: State = ((0, NOTHING, 0),)


class Transducer:
    """States and transitions over the characters of a vocabulary of pieces with greedy merges."""

    def __init__(self, pieces: dict[str, int], merger: PairMerger, most: int = STATES):
        self.merger, self.most = merger, most
        self.letters = {i: [pieces[c] for c in p] for p, i in pieces.items() if all(c in pieces for c in p)}
        self.last_char = {i: p[-1] for p, i in pieces.items()}
        self.known = {p for p in pieces if len(p) == 1}
        self.inside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[int] = [NOTHING]
        for p, i in pieces.items():
            # a piece that its own characters don't merge to is never a token
            if i in self.letters and merger.merge_long(self.letters[i]) == [i]:
                node = 0
                for c in p:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.piece.append(NOTHING)
                    node = self.children[node][c]
                self.piece[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: list[State] = []
        self.number: dict[State, int] = {}
        self.table: list[dict[str, tuple[int, int]]] = []
        self.intern(INITIAL)

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens, side by side, stay two tokens."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merger.merge_long(self.letters[a] + self.letters[b]) == [a, b]
        return got

    def intern(self, state: State) -> int:
        """The state's number in the table."""
        at = self.number.get(state)
        if at is None:
            if len(self.states) >= self.most:  # forget all; who holds a number holds the one that comes back here
                for kept in (self.states, self.number, self.table):
                    kept.clear()
                if state != INITIAL:
                    self.intern(INITIAL)
            at = self.number[state] = len(self.states)
            self.states.append(state)
            self.table.append({})
        return at

    def compile(self, at: int, c: str) -> tuple[int, int]:
        """Make the transition from a state by a character: next state, tokens added."""
        places, row = self.states[at], self.table[at]
        if c not in self.known:  # one token a byte, and nothing merges with them
            row[c] = out = (self.intern(INITIAL), len(c.encode()))
            return out
        going, token, added = [], NOTHING, 0
        for node, before, fewer in places:
            child = self.children[node].get(c)
            if child is None:
                continue
            if not node and before != NOTHING and self.last_char[before] + c not in self.inside:
                before = NOTHING  # a certain cut
            p = self.piece[child]
            if p != NOTHING and token == NOTHING and (before == NOTHING or self.apart(before, p)):
                token, added = p, fewer + 1
            if self.children[child]:
                going.append((child, before, fewer))
        state = (*((child, before, fewer - added) for child, before, fewer in going), (0, token, 0))
        row[c] = out = (self.intern(state), added)  # a row that intern() has forgotten does no harm
        return out

    def read(self, text: str, state: State = INITIAL) -> tuple[int, State]:
        """Tokens that a text adds from a state, and the state behind it."""
        table, at, n = self.table, self.intern(state), 0
        for c in text:
            hit = table[at].get(c)
            if hit is None:
                hit = self.compile(at, c)
            at, added = hit
            n += added
        return n, self.states[at]


class PieceCounter:
    """A sentencepiece model of kind BPE with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, path: str, states: int = STATES, remembered: int = SEGMENTS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        score = {i: model.get_score(i) for i in plain}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        merger = PairMerger({(pieces[p[:k]], pieces[p[k:]]): (rank[score[i]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces})
        self.transducer = Transducer(pieces, merger, states)
        # what `segments` takes for certain must hold for this vocabulary
        if any(b == MARK and a != MARK or "\n" in (a, b) for a, b in self.transducer.inside):
            raise ValueError("pieces of this model cross spaces or lines")
        self.memory = Memory(lambda found: [self.read(s)[0] for s in found], remembered)

    def read(self, data: bytes, state: State = INITIAL) -> tuple[int, State]:
        return self.transducer.read(data.decode("utf-8", "replace").replace(SPACE, MARK), state)

    def tokens(self, found: list[bytes]) -> int:
        """Tokens of segments; short ones are in memory."""
        if not found or max(map(len, found)) <= SHORT:
            return sum(map(self.memory.__getitem__, found))
        return sum(self.memory[s] if len(s) <= SHORT else self.read(s)[0] for s in found)

    def chunk_map(self, found: list[bytes]) -> Map:
        """The map of a chunk with these segments, of which the first and the last may go on in its neighbours."""
        if len(found) < 2:
            return b"".join(found), None
        n, state = self.read(found[-1])
        return found[0], (self.tokens(found[1:-1]) + n, state)

    def compose(self, a: Map, b: Map) -> Map:
        """The map of two neighbouring chunks."""
        if a[1] is None:
            return a[0] + b[0], b[1]
        n, state = self.read(b[0], a[1][1])
        return a[0], (a[1][0] + n, state) if b[1] is None else (a[1][0] + n + b[1][0], b[1][1])

    def count_all(self, texts: list[bytes], chunk: int = CHUNK) -> list[int]:
        """Tokens of whole texts."""
        chunked = []
        for text in texts:
            data = b" " + text.replace(MARK.encode(), b" ") if text else b""
            chunked.append([segments(part) for part in chunks(data, chunk)])
        self.memory.learn([[s for s in found if len(s) <= SHORT] for one in chunked for found in one])
        out = []
        for one in chunked:
            if len(one) == 1:  # no neighbours: all its segments are whole
                out.append(self.tokens(one[0]))
                continue
            maps = [self.chunk_map(found) for found in one]
            while len(maps) > 1:
                maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            head, behind = maps[0] if maps else (b"", None)
            out.append(self.read(head)[0] + (behind[0] if behind else 0))
        return out

    def count(self, text: bytes, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        return self.count_all([text], chunk)[0]


def chunks(data: bytes, size: int) -> list[bytes]:
    """Chunks of about `size` bytes that part no character."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


KEPT.append(load.cache_clear)


def count_tokens(df: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = load(path)
        texts = as_bytes(batch.column(1))
        n = np.array([n for some in groups(texts) for n in counter.count_all(some)], np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return arrow_rows(spread(df.select(key, text)), run, f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean")
