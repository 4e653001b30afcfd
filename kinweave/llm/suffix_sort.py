"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Induced sorting classifies suffixes as smaller or larger than their right neighbour, sorts the leftmost-smaller (LMS)
substrings, names them, sorts the string of names, and induces the order of all other suffixes from the LMS suffixes in one
pass to the right and one to the left. The passes run bucket by bucket (a bucket holds the suffixes of one first symbol);
what a bucket induces into itself is taken in waves, one for each further place of a run of that symbol, so each wave is
a few operations on arrays. The sort of LMS substrings is the same induction from unsorted LMS places. The string of
names, a third of the text or less, has too many symbols for buckets; it is sorted by doubling over ranks, and only as
far as names still tie.

The common prefix of a suffix and its predecessor in the array is at least that of the suffix before it in the text less
one, and exactly that wherever the bytes before both are equal (a reducible place). So it is measured by comparing bytes at
the irreducible places alone and carried on from there in text order (Karkkainen, Manzini and Puglisi, 2009).
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one to its right (S type); t ends in a unique smallest symbol."""
    n = len(t)
    step = np.diff(t)  # of places 0 .. n - 2
    # within a run of equal symbols the type is that of the run's last place
    nxt = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 2))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[nxt] > 0
    return out


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from LMS places given in order (grouped by first symbol)."""
    n, symbols = len(t), np.flatnonzero(counts)
    heads = np.concatenate([[0], np.cumsum(counts)])
    sa = np.full(n, -1, np.int32)
    sa[0] = n - 1  # the end, which nothing induces
    first = t[lms]
    bounds = np.searchsorted(first, np.arange(len(counts) + 1))
    of_lms = {int(c): lms[bounds[c] : bounds[c + 1]] for c in symbols}
    # to the right: L suffixes fill their buckets from the front
    front = heads[:-1].copy()

    def spread(places: np.ndarray, own: int, want: bool, at: np.ndarray, forward: bool) -> np.ndarray:
        """Put the left neighbours of `places` that have the wanted type into their buckets; return those of bucket `own`."""
        left = places - 1
        if forward:  # the first place of all has no left neighbour; it is met as -1 at most once
            left = left[left >= 0]
            left = left[~s_type[left]]
        else:
            left = left[s_type[left] & (left >= 0)]
        if not len(left):
            return left
        c = t[left]
        mine = left[c == own]
        order = np.argsort(c, kind="stable")
        left, c = left[order], c[order]
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(c)]]))
        # runs of one symbol lie side by side on both sides, but for where their bucket stands
        if forward:
            first = at[c[starts]]
            sa[np.arange(len(c)) + np.repeat(first - starts, sizes)] = left
            at[c[starts]] += sizes
        else:
            first = at[c[starts]]
            sa[np.repeat(first + starts, sizes) - np.arange(len(c))] = left
            at[c[starts]] -= sizes
        return mine

    for c in symbols:
        lo = heads[c]
        wave = sa[lo : front[c]].copy()
        while len(wave):
            wave = spread(wave, c, False, front, True)
        if len(of_lms[int(c)]):
            # their left neighbours are L suffixes of larger symbols
            spread(of_lms[int(c)], c, False, front, True)
    # to the left: S suffixes fill their buckets from the back
    back = heads[1:] - 1
    for c in symbols[::-1]:
        wave = sa[back[c] + 1 : heads[c + 1]][::-1].copy()
        while len(wave):
            wave = spread(wave, c, True, back, False)
        larger = sa[heads[c] : front[c]][::-1]
        if len(larger):
            spread(larger, c, True, back, False)
    return sa


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a string of names, by doubling over ranks; names that no other shares are settled."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    order = np.argsort(rank)
    sorted_ = rank[order]
    # rank: place of the first of its group
    start = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    while True:
        single = start & np.concatenate([start[1:], [True]])
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        who = order[tied]
        after = who + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        key = first[tied] * (n + 1) + second + 1
        sub = np.argsort(key)
        order[tied], key = who[sub], key[sub]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start[tied] = new
        first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        rank[order[tied]] = first[tied]
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a byte array; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    t = np.concatenate([text.astype(np.int16) + 1, [0]]).astype(np.int16)
    counts = np.bincount(t, minlength=257)
    s_type = _types(t)
    lms = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(np.int32)
    # LMS substrings in order: induce from LMS places sorted by first symbol alone
    sa = _induce(t, s_type, lms[np.argsort(t[lms], kind="stable")], counts)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    by_substring = sa[is_lms[sa]]
    # equal neighbours get one name: compare the substrings up to and with the next LMS place
    end = np.append(lms[1:], n)
    nth = np.empty(n + 1, np.int32)
    nth[lms] = np.arange(len(lms), dtype=np.int32)
    at = nth[by_substring]
    length = end[at] - by_substring + 1
    same = np.zeros(len(at), bool)
    a, b = by_substring[:-1], by_substring[1:]
    alike = np.flatnonzero(length[:-1] == length[1:])
    k = 0
    padded = np.concatenate([t, np.zeros(8, np.int16)])
    while len(alike):
        alike = alike[padded[a[alike] + k] == padded[b[alike] + k]]
        k += 1
        whole = k >= length[:-1][alike]
        same[alike[whole] + 1] = True
        alike = alike[~whole]
    names = np.empty(len(lms), np.int64)
    names[at] = np.cumsum(~same) - 1
    lms = lms[_rank_names(names)]
    return _induce(t, s_type, lms, counts)[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """plcp: for each place of the text, the common prefix of its suffix and that suffix's predecessor in the array."""
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n, dtype=np.int32)
    irreducible = np.ones(n, bool)
    p, q = place[1:], before[1:]
    fine = q > 0
    irreducible[1:][fine] = text[p[fine] - 1] != text[q[fine] - 1]
    heads = np.flatnonzero(irreducible)
    length = np.zeros(len(heads), np.int64)
    live = np.flatnonzero(before[heads] >= 0)
    # eight bytes at a time, then the rest
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))
    a, b = heads[live], before[heads[live]]
    while len(live):
        room = np.minimum(n - a, n - b)
        x = np.ascontiguousarray(words[np.minimum(a, n - 1)]).view("<u8").ravel() ^ np.ascontiguousarray(words[np.minimum(b, n - 1)]).view("<u8").ravel()
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        equal = np.minimum(equal, room)
        length[live] += equal
        more = equal == 8
        live, a, b = live[more], a[more] + 8, b[more] + 8
        ends = (a < n) & (b < n)
        live, a, b = live[ends], a[ends], b[ends]
    # the value falls by one from each irreducible place to the next
    return np.repeat(length + heads, np.diff(np.append(heads, n))) - place
