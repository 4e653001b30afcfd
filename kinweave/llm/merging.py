"""Greedy pair merging over contiguous rank arrays, for many short words at once.

Each word is a row of part ids. Beside it lies a row with the rank of every adjacent pair. One round looks for the
smallest rank of each row (the leftmost on ties), puts the merged part in place, deletes the boundary by moving the rest
of the row one place to the left, and looks up the two ranks that touch the new part. Rows without a mergeable pair
leave. Words beyond LONG parts go through a heap over linked parts with the same order, so that a giant word costs
n log n instead of n squared.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
LONG = 48


class PairMerger:
    """pairs: (left id, right id) -> (rank, merged id). Lower ranks merge first, equal ranks from the left."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        keys = np.array([(a << 32) | b for a, b in pairs] or [0], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()] or [NONE], np.int32)[order]
        self.merged = np.array([m for _, m in pairs.values()] or [0], np.int32)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and positions in the table of many pairs; id -1 pads."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), at

    def merge(self, words: list[list[int]]) -> list[list[int]]:
        """The parts of each word after all merges."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at = int(np.searchsorted(sizes[order], 2))
        for i in order[:at]:
            out[i] = list(words[i])
        while at < len(order) and sizes[order[at]] <= LONG:
            width = min(LONG, max(8, 1 << int(sizes[order[at]] - 1).bit_length()))
            end = int(np.searchsorted(sizes[order], width, "right"))
            for lo in range(at, end, 8192):
                some = order[lo : min(end, lo + 8192)]
                for i, parts in zip(some, self._merge_rows([words[i] for i in some], width), strict=True):
                    out[i] = parts
            at = end
        for i in order[at:]:
            out[i] = self.merge_long(words[i])
        return out

    def _merge_rows(self, words: list[list[int]], width: int) -> list[list[int]]:
        n = len(words)
        parts = np.full((n, width + 1), -1, np.int32)
        size = np.fromiter(map(len, words), np.int64, n)
        parts[np.arange(width + 1) < size[:, None]] = np.concatenate([np.asarray(w, np.int32) for w in words])
        ranks, at = self._rank(parts[:, :-1], parts[:, 1:])
        at = at.astype(np.int32)
        live, columns = np.arange(n), np.arange(width + 1)
        done = np.empty((n, width + 1), np.int32)
        while len(live):
            best = ranks.argmin(1)
            row = np.arange(len(live))
            more = ranks[row, best] != NONE
            if not more.all():
                done[live[~more]] = parts[~more]
                live, parts, ranks, at, best = live[more], parts[more], ranks[more], at[more], best[more]
                row = np.arange(len(live))
                if not len(live):
                    break
            parts[row, best] = self.merged[at[row, best]]
            move = columns[None, :] + (columns[None, :] > best[:, None])  # the boundary after `best` goes
            move[:, -1] = width
            parts = np.take_along_axis(parts, np.minimum(move, width), 1)
            parts[:, -1] = -1
            move = np.minimum(columns[None, :-1] + (columns[None, :-1] > best[:, None]), width - 1)
            ranks, at = np.take_along_axis(ranks, move, 1), np.take_along_axis(at, move, 1)
            ranks[:, -1] = NONE
            ranks[row, best], at[row, best] = self._rank(parts[row, best], parts[row, best + 1])
            left = best > 0
            row, best = row[left], best[left]
            ranks[row, best - 1], at[row, best - 1] = self._rank(parts[row, best - 1], parts[row, best])
        keep = done >= 0
        return [r.tolist() for r in np.split(done[keep], np.cumsum(keep.sum(1))[:-1])]

    def merge_long(self, word: list[int]) -> list[int]:
        """The same for one long word, with a heap of (rank, place)."""
        part = list(word)
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.pairs[p][0], i, *p) for i, p in enumerate(zip(part, part[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] == a else n
            if j >= n or part[j] != b:
                continue
            part[i], part[j] = self.pairs[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (found := self.pairs.get((part[x], part[after[x]]))):
                    heapq.heappush(heap, (found[0], x, part[x], part[after[x]]))
        return [x for x in part if x >= 0]
