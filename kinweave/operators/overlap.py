"""Rows that share words, counted where two groups of rows meet, so that no pair is sent between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Shared words that are counted at once, places that are counted for them, and pairs of an Arrow batch.
COUNTED, PLACES, BATCH = 2_000_000, 8_000_000, 200_000


class Side:
    """Rows by their lists of words; equal lists become one class, which is counted once.

    rows: the rows' numbers; words of all rows one after another, each row's sorted, and the cuts between them.
    """

    def __init__(self, rows: np.ndarray, words: np.ndarray, cuts: np.ndarray):
        seen: dict[bytes, int] = {}
        of, first = np.empty(len(rows), np.int64), []
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            of[k] = seen.setdefault(words[a:b].tobytes(), len(seen))
            if of[k] == len(first):
                first.append(k)
        self.sizes = np.bincount(of, minlength=len(first))
        self.members, self.start = rows[np.argsort(of, kind="stable")], np.cumsum(self.sizes) - self.sizes
        lengths = np.diff(cuts)[first]
        self.owner = np.repeat(np.arange(len(first), dtype=np.int32), lengths)
        kept = np.zeros(len(rows), bool)
        kept[first] = True
        self.words = words[np.repeat(kept, np.diff(cuts))]

    def __len__(self) -> int:
        return len(self.sizes)


def shared(one: Side, two: Side, support: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes of the two sides that share at least `support` words, and how many, some classes of the first side at a time."""
    order = np.argsort(two.words, kind="stable")
    held, owner = two.words[order], two.owner[order]
    del order
    low = np.searchsorted(held, one.words, "left").astype(np.int32)
    n = np.searchsorted(held, one.words, "right").astype(np.int32) - low
    some = n > 0
    low, n, row = low[some], n[some], one.owner[some]
    cuts = np.searchsorted(row, np.arange(len(one) + 1))
    load = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[cuts]
    at = 0
    while at < len(one):
        end = int(np.searchsorted(load, load[at] + COUNTED, "right")) - 1
        end = max(at + 1, min(end, at + PLACES // len(two), len(one)))
        now, total = slice(cuts[at], cuts[end]), int(load[end] - load[at])
        if total:
            k = n[now]
            pairs = owner[np.arange(total) + np.repeat(low[now] - (np.cumsum(k, dtype=np.int64) - k), k)].astype(np.int64)
            pairs += np.repeat((row[now] - at).astype(np.int64) * len(two), k)
            if (end - at) * len(two) <= 16 * total:
                counts = np.bincount(pairs)
                found = np.flatnonzero(counts >= support)
                counts = counts[found]
            else:
                found, counts = np.unique(pairs, return_counts=True)
                found, counts = found[counts >= support], counts[counts >= support]
            yield at + found // len(two), found % len(two), counts
        at = end


def row_pairs(one: Side, two: Side, support: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that share at least `support` words, each pair once with the smaller number first, and how many; two may be one."""
    for a, b, n in shared(one, two, support):
        if one is two:
            a, b, n = a[a <= b], b[a <= b], n[a <= b]
        of_b = two.sizes[b]
        ends = np.cumsum(one.sizes[a] * of_b)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, BATCH):
            stop = min(begin + BATCH, int(ends[-1]))
            u, v = np.searchsorted(ends, [begin, stop - 1], "right")
            before = np.concatenate([[0], ends])[u : v + 1] if u == 0 else ends[u - 1 : v]
            k = np.repeat(np.arange(u, v + 1), np.minimum(ends[u : v + 1], stop) - np.maximum(before, begin))
            place = np.arange(begin, stop) - before[k - u]
            x = one.members[one.start[a[k]] + place // of_b[k]]
            y = two.members[two.start[b[k]] + place % of_b[k]]
            if one is two:
                once = (a[k] != b[k]) | (x < y)
                x, y, k = x[once], y[once], k[once]
            if len(k):
                yield np.minimum(x, y), np.maximum(x, y), n[k]
