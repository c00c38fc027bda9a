"""Suffix arrays of byte strings by induced sorting, a bucket of suffixes at a time in numpy."""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the places of leftmost ones of such runs; t ends in a least symbol."""
    n = len(t)
    change = np.sign(np.diff(t))
    nearest = np.where(change != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = change[np.minimum(nearest, n - 2)] > 0 if n > 1 else True
    first = smaller.copy()
    first[0] = False
    first[1:] &= ~smaller[:-1]
    return smaller, np.flatnonzero(first)


def _append(sa: np.ndarray, at: np.ndarray, t: np.ndarray, new: np.ndarray, step: int) -> None:
    """Put suffixes, in this order, at the open ends `at` of their buckets; step is the direction of growth."""
    c = t[new]
    order = np.argsort(c, kind="stable")
    c, new = c[order], new[order]
    begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.append(begin, len(c)))
    rank = np.arange(len(c)) - np.repeat(begin, count)
    sa[at[c] + step * rank] = new
    at[c[begin]] += step * count


def induce(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in order: larger suffixes from the left, then smaller from the right."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    begins = ends - counts
    symbols = np.flatnonzero(counts)
    sa = np.full(n, -1, np.int64)
    left = begins.copy()
    seeds = leftmost[np.argsort(t[leftmost], kind="stable")]
    seed_end = np.cumsum(np.bincount(t[leftmost], minlength=size))
    seed_begin = seed_end - np.bincount(t[leftmost], minlength=size)
    for c in symbols.tolist():
        done = int(begins[c])
        while done < left[c]:  # suffixes that come into this bucket from itself make a further wave
            wave = sa[done : left[c]]
            done = int(left[c])
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _append(sa, left, t, before, 1)
        before = seeds[seed_begin[c] : seed_end[c]]
        before = before[before > 0] - 1
        if len(before):
            _append(sa, left, t, before, 1)
    right = ends - 1
    for c in symbols[::-1].tolist():
        done = int(ends[c]) - 1
        while done > right[c]:
            wave = sa[right[c] + 1 : done + 1][::-1]
            done = int(right[c])
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _append(sa, right, t, before, -1)
        wave = sa[begins[c] : left[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _append(sa, right, t, before, -1)
    sa[0] = n - 1  # the end mark precedes all
    return sa


def _named(t: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray, smaller: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of leftmost-smaller substrings, in text order, from an order of them; equal substrings share a name."""
    n = len(t)
    stop = np.zeros(n, np.int64)
    stop[leftmost] = np.append(leftmost[1:], n - 1)
    a, b = ordered[:-1], ordered[1:]
    same = (stop[a] - a == stop[b] - b) & (t[a] == t[b])
    left = np.flatnonzero(same)
    k = 1
    while len(left):
        left = left[stop[a[left]] - a[left] >= k]
        differ = t[a[left] + k] != t[b[left] + k]
        same[left[differ]] = False
        left = left[~differ]
        k += 1
    names = np.zeros(n, np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return names[leftmost], int((~same).sum()) + 1


def _sorted_names(names: np.ndarray, distinct: int) -> np.ndarray:
    """Suffix order of the reduced string: names of pairs, of pairs of pairs and so on, until all differ."""
    n, reach = len(names), 1
    while distinct < n:
        after = np.full(n, -1, np.int64)
        after[:-reach] = names[reach:]
        key = names * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        changed = key[order][1:] != key[order][:-1]
        names = np.empty(n, np.int64)
        names[order] = np.concatenate([[0], np.cumsum(changed)])
        distinct = int(changed.sum()) + 1
        reach *= 2
    return np.argsort(names, kind="stable")


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of a byte string."""
    if len(data) < 2:
        return np.arange(len(data))
    t = np.append(data.astype(np.int64) + 1, 0)
    smaller, leftmost = classify(t)
    once = induce(t, smaller, leftmost, 257)
    is_leftmost = np.zeros(len(t), bool)
    is_leftmost[leftmost] = True
    ordered = once[is_leftmost[once]]
    names, distinct = _named(t, leftmost, ordered, smaller)
    leftmost = leftmost[_sorted_names(names, distinct)]
    return induce(t, smaller, leftmost, 257)[1:]


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """By place in the text: length, as far as `limit`, that its suffix shares with the one before it in sa.

    sa may leave out suffixes; places it doesn't have get 0. Places are compared side by side, eight bytes at a time.
    """
    out = np.zeros(len(data), np.int64)
    padded = np.append(data, np.zeros(limit + 8, np.uint8))
    left, right = sa[:-1], sa[1:]
    k = 0
    while len(left) and k < limit:
        width = min(8, limit - k)
        equal = np.ones(len(left), bool)
        for x in range(width):
            equal &= (padded[left + k + x] == padded[right + k + x]) & (np.maximum(left, right) + k + x < len(data))
            out[right[equal]] += 1
        left, right = left[equal], right[equal]
        k += width
    return out
