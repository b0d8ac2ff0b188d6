"""Suffix arrays by induced sorting, and permuted longest common prefixes, for one shard of text in memory.

Suffixes are classified as larger (L) or smaller (S) than the next one. The leftmost S suffixes of each run (LMS) are sorted by
sorting their substrings, recursively where these are not all different; all other suffixes follow in two linear passes. Over
bytes the passes work bucket by bucket on whole numpy arrays; over the names of a recursion, whose buckets are tiny, they are
plain loops.
"""

from __future__ import annotations

import numpy as np


def _is_smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the last symbol is a sentinel, smaller than all others."""
    n = len(s)
    rising = np.zeros(n, bool)
    rising[:-1] = s[:-1] < s[1:]
    rising[-1] = True
    decided = np.ones(n, bool)
    decided[:-1] = s[:-1] != s[1:]
    # The next position that is decided, from the right.
    at = np.where(decided, np.arange(n), n)
    return rising[np.minimum.accumulate(at[::-1])[::-1]]


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the given order."""
    n = len(s)
    counts = np.bincount(s, minlength=symbols)
    return (_induce_by_bucket if symbols * 64 < n else _induce_by_loop)(s, smaller, lms, counts)


def _place_lms(s: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's LMS suffixes go, at its end, in order."""
    ends = np.cumsum(counts)
    order = np.argsort(s[lms], kind="stable")
    placed = lms[order]
    per_bucket = np.bincount(s[lms], minlength=len(counts))
    begins = ends - per_bucket
    rank = np.arange(len(placed)) - np.repeat(np.cumsum(per_bucket) - per_bucket, per_bucket)
    return placed, np.repeat(begins, per_bucket) + rank


def _spread(keys: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, the keys in that order, and each one's rank among its equals."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(ordered)))
    return order, ordered, np.arange(len(ordered)) - np.repeat(first, sizes)


def _induce_by_bucket(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n, symbols = len(s), len(counts)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(n, -1, np.int64)
    placed, where = _place_lms(s, lms, counts)
    lms_first = ends - np.bincount(s[lms], minlength=symbols)
    sa[where] = placed

    # Larger suffixes, from the front of their buckets: first what a bucket's L suffixes induce, while they still grow, then its LMS.
    heads = begins.copy()

    def larger(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            order, keys, rank = _spread(s[before], symbols)
            sa[heads[keys] + rank] = before[order]
            heads[:] += np.bincount(keys, minlength=symbols)

    for c in np.flatnonzero(counts):
        at = begins[c]
        while at < heads[c]:
            stop = heads[c]
            larger(sa[at:stop].copy())
            at = stop
        larger(sa[lms_first[c] : ends[c]].copy())

    # Smaller suffixes, from the back of their buckets; the LMS entries are written anew.
    last_larger = heads
    tails = ends.copy()

    def lesser(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[smaller[before]]
        if len(before):
            order, keys, rank = _spread(s[before], symbols)
            sa[tails[keys] - 1 - rank] = before[order]
            tails[:] -= np.bincount(keys, minlength=symbols)

    for c in np.flatnonzero(counts)[::-1]:
        at = ends[c]
        while at > tails[c]:
            stop = tails[c]
            lesser(sa[stop:at][::-1].copy())
            at = stop
        lesser(sa[begins[c] : last_larger[c]][::-1].copy())
    sa[0] = n - 1
    return sa


def _induce_by_loop(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(s)
    placed, where = _place_lms(s, lms, counts)
    array = np.full(n, -1, np.int64)
    array[where] = placed
    sa, text, kind = array.tolist(), s.tolist(), smaller.tolist()
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            sa[heads[c]] = j
            heads[c] += 1
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and kind[j]:
            c = text[j]
            tails[c] -= 1
            sa[tails[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _names(s: np.ndarray, sorted_lms: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A name for each LMS suffix in sorted order: equal names for equal LMS substrings (``length`` by position)."""
    a, b = sorted_lms[:-1], sorted_lms[1:]
    same = length[a] == length[b]
    active, k = np.flatnonzero(same), 0
    while len(active):
        equal = s[a[active] + k] == s[b[active] + k]
        same[active[~equal]] = False
        active = active[equal]
        k += 1
        active = active[length[a[active]] > k]
    return np.concatenate([[0], np.cumsum(~same)])


def _sorted_suffixes(s: np.ndarray, symbols: int) -> np.ndarray:
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _is_smaller(s)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    length = np.ones(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    sa = _induce(s, smaller, lms, symbols)
    sorted_lms = sa[is_lms[sa]]
    names = _names(s, sorted_lms, length)
    if names[-1] + 1 < len(lms):
        by_position = np.empty(n, np.int64)
        by_position[sorted_lms] = names
        sorted_lms = lms[_sorted_suffixes(by_position[lms], int(names[-1]) + 1)]
    return _induce(s, smaller, sorted_lms, symbols)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a byte array, in lexicographic order."""
    if not len(data):
        return np.zeros(0, np.int64)
    return _sorted_suffixes(np.concatenate([data.astype(np.int16) + 1, [0]]).astype(np.int16), 257)[1:]


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, how many bytes its suffix shares with the one before it in the suffix array.

    In text order the sum of position and prefix never falls, and it stays the same wherever the bytes before both suffixes are
    equal. So only the other positions are compared, eight bytes at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    compared = before >= 0
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    compared[inner] = data[inner - 1] != data[before[inner] - 1]
    at = np.flatnonzero(compared)
    other, shared = before[at], np.zeros(len(at), np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    active = np.arange(len(at))
    while len(active):
        a, b = at[active] + shared[active], other[active] + shared[active]
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        same = np.minimum(np.argmin(np.concatenate([eight[a] == eight[b], np.zeros((len(a), 1), bool)], axis=1), axis=1), n - np.maximum(a, b))
        shared[active] += same
        active = active[same == 8]
    reach = np.zeros(n, np.int64)
    reach[at] = at + shared
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0) * (before >= 0)


def repeated_windows(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions begin a window that fits its string, and which of these begin a window that also begins earlier.

    ``ends``: end of the string that each position lies in. Strings lie in order, parted by a byte that none of them has.
    """
    sa = suffix_array(data)
    shared = permuted_common_prefixes(data, sa)[sa]
    fits = np.arange(len(data)) + window <= ends
    group = np.flatnonzero(shared < window)
    first = np.minimum.reduceat(sa, group)
    again = np.zeros(len(data), bool)
    again[sa] = sa != np.repeat(first, np.diff(np.append(group, len(sa))))
    return fits, again & fits
