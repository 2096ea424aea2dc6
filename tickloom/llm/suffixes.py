"""Suffix arrays by induced sorting, and permuted common prefixes, over whole numpy arrays.

Induced sorting places suffixes bucket by bucket: what a bucket's suffixes induce goes to the ends of
other buckets, in order. Within a bucket all suffixes found so far are handled at once, so a text needs
as many array operations as it has buckets, times the longest run of one character.
"""

from __future__ import annotations

import numpy as np

from tickloom.llm.common import Rolling


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is."""
    n = len(text)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    differ = np.flatnonzero(text[1:] != text[:-1])
    if len(differ):
        upto = np.searchsorted(differ, np.arange(n - 1))
        known = upto < len(differ)
        at = differ[upto[known]]
        smaller[:-1][known] = text[at] < text[at + 1]
    return smaller


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in the order that they have among themselves."""

    def sweep(chars: range, own: dict[int, list[np.ndarray]], kind: bool, queued: dict[int, list[np.ndarray]]) -> dict[int, np.ndarray]:
        """One pass over the buckets; ``own`` holds what stands in a bucket after the suffixes of this kind."""
        done: dict[int, np.ndarray] = {}

        def push(found: np.ndarray, here: int) -> np.ndarray:
            before = found[found > 0] - 1
            before = before[smaller[before] == kind]
            if not len(before):
                return before
            c = text[before]
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
            again = before[:0]
            for part, first in zip(np.split(before, cuts), c[np.concatenate(([0], cuts))].tolist(), strict=True):
                if first == here:
                    again = part
                else:
                    queued.setdefault(first, []).append(part)
            return again

        for c in chars:
            waves = queued.pop(c, [])
            wave = np.concatenate(waves) if waves else seeds[:0]
            mine = [wave]
            while len(wave):
                wave = push(wave, c)
                mine.append(wave)
            done[c] = np.concatenate(mine)
            for rest in own.get(c, []):
                push(rest, -1)
        return done

    seeded: dict[int, list[np.ndarray]] = {}
    c = text[seeds]
    order = np.argsort(c, kind="stable")
    cuts = np.flatnonzero(np.diff(c[order])) + 1
    for part in np.split(seeds[order], cuts):
        if len(part):
            seeded[int(text[part[0]])] = [part]
    larger = sweep(range(size), seeded, False, {})
    small = sweep(range(size - 1, -1, -1), {k: [v[::-1]] for k, v in larger.items()}, True, {0: [np.array([len(text) - 1])]})
    out = []
    for k in range(size):
        out += [larger[k], small[k][::-1]]
    return np.concatenate(out)


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by their first ``depth`` names at least, else by place."""
    rank, span = names.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-span] = rank[span:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        s = key[order]
        fresh = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = np.empty(len(rank), np.int64)
        rank[order] = fresh
        span *= 2
        if fresh[-1] == len(rank) - 1 or span >= min(depth, len(rank)):
            return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` characters; it ends with its only, smallest 0.

    Leftmost-smaller substrings are sorted by inducing, named, and the string of their names is sorted
    in turn, unless all differ. Its alphabet is as long as the string, where buckets are no help, so
    that is done by doubling ranks, up to the depth.
    """
    size = int(text.max()) + 1
    smaller = classify(text)
    leftmost = smaller.copy()
    leftmost[0] = False
    leftmost[1:] &= ~smaller[:-1]
    places = np.flatnonzero(leftmost)
    if len(places) < 2:
        return induce(text, smaller, places, size)
    order = induce(text, smaller, places, size)
    order = order[leftmost[order]]
    ends = np.empty(len(text), np.int64)
    ends[places] = np.append(places[1:] + 1, len(text))
    hashes, lengths = Rolling(text).span(order, ends[order]), ends[order] - order
    named = np.cumsum(np.concatenate(([0], (hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1]))))
    if named[-1] < len(order) - 1:
        name_at = np.empty(len(text), np.int64)
        name_at[order] = named
        order = places[_doubling(name_at[places], depth // 2 + 2)]
    return induce(text, smaller, order, size)


def permuted_common_prefixes(text: np.ndarray, suffixes: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``at`` the longest common prefix with a neighbour in the suffix array, counted up to ``most``."""
    n = len(text)
    sums = Rolling(text)
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.arange(n)
    best = np.zeros(len(at), np.int64)
    for step in (-1, 1):
        r = rank[at] + step
        ok = (r >= 0) & (r < n)
        a, b = at[ok], suffixes[r[ok]]
        room = np.minimum(most, n - np.maximum(a, b))
        full = sums.span(a, a + room) == sums.span(b, b + room)
        low, high = np.where(full, room, 0), np.where(full, room, room - 1)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = sums.span(a, a + mid) == sums.span(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        best[ok] = np.maximum(best[ok], low)
    return best


def reaching(text: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """For each place, whether its permuted common prefix reaches ``length``; one comparison a neighbour, without a search."""
    n = len(text)
    out = np.zeros(n, bool)
    if n <= length:
        return out
    windows = Rolling(text).every(length)
    ordered = suffixes[suffixes <= n - length]
    found = windows[ordered]
    same = found[1:] == found[:-1]
    out[ordered[1:][same]] = True
    out[ordered[:-1][same]] = True
    return out
