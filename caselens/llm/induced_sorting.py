"""Suffix arrays by induced sorting, one bucket at a time in numpy, and common prefixes."""

from __future__ import annotations

import numpy as np

from . import blocks


def _spread(targets: np.ndarray, free: np.ndarray, step: int) -> np.ndarray:
    """Slots for values going to buckets ``targets`` in order; moves the free ends."""
    order = np.argsort(targets, kind="stable")
    count = np.bincount(targets, minlength=len(free))
    rank = np.empty(len(targets), np.int64)
    rank[order] = np.arange(len(targets)) - np.repeat(np.cumsum(count) - count, count)
    slots = free[targets] + rank if step > 0 else free[targets] - 1 - rank
    free += step * count
    return slots


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes induced from ``lms`` positions given in their order."""
    n = len(s)
    count = np.bincount(s)
    tails = np.cumsum(count)
    heads = tails - count
    larger_count = np.bincount(s[~smaller], minlength=len(count))
    out = np.full(n, -1, np.int64)
    lms_count = np.bincount(s[lms], minlength=len(count))
    by_char = lms[np.argsort(s[lms], kind="stable")]
    lms_first = np.cumsum(lms_count) - lms_count
    free = heads.copy()
    for c in np.flatnonzero(count).tolist():
        away, begin = [], heads[c]
        while begin < free[c]:
            j = out[begin:free[c]] - 1
            begin = free[c]
            j = j[j >= 0]
            j = j[~smaller[j]]
            same = s[j] == c
            stay = j[same]
            out[free[c]:free[c] + len(stay)] = stay
            free[c] += len(stay)
            away.append(j[~same])
        j = by_char[lms_first[c]:lms_first[c] + lms_count[c]] - 1
        away.append(j[j >= 0])
        away = np.concatenate(away)
        if len(away):
            out[_spread(s[away], free, 1)] = away
    free = tails.copy()
    out[0] = n - 1
    free[0] -= 1
    for c in np.flatnonzero(count)[::-1].tolist():
        away, begin = [], tails[c]
        while begin > free[c]:
            j = out[free[c]:begin][::-1] - 1
            begin = free[c]
            j = j[j >= 0]
            j = j[smaller[j]]
            same = s[j] == c
            stay = j[same]
            out[free[c] - len(stay):free[c]] = stay[::-1]
            free[c] -= len(stay)
            away.append(j[~same])
        j = out[heads[c]:heads[c] + larger_count[c]][::-1] - 1
        j = j[j >= 0]
        away.append(j[smaller[j]])
        away = np.concatenate(away)
        if len(away):
            out[_spread(s[away], free, -1)] = away
    return out


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: runs of twice as many names are named
    from their halves until every suffix has a name of its own."""
    m, width = len(names), 1
    while True:
        after = np.zeros(m, np.int64)
        after[:max(0, m - width)] = names[width:] + 1
        values, names = np.unique(names * (m + 1) + after, return_inverse=True)
        if len(values) == m:
            return np.argsort(names)
        width *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order; ``s`` ends in its only 0, values below 1024.

    Suffixes are classified as smaller or larger than their successor; the substrings
    between leftmost smaller ones are sorted by inducing and named; the string of names is
    sorted recursively, and its order induces that of all suffixes.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    change = np.sign(np.diff(s))
    place = np.where(change != 0, np.arange(n - 1), n)
    place = np.minimum.accumulate(place[::-1])[::-1]
    smaller = np.append(change[place] > 0, True)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    first = _induce(s, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    ends = np.append(lms[1:] + 1, n)
    up, down = blocks.powers(n + 1)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(blocks.mix(s.astype(np.uint64) + np.uint64(1)) * up[:n], out=running[1:])
    print_of = np.zeros(n, np.uint64)
    print_of[lms] = blocks.mix((running[ends] - running[lms]) * down[lms]
                               + (ends - lms).astype(np.uint64))
    prints = print_of[ordered]
    names = np.cumsum(np.append(False, prints[1:] != prints[:-1]))
    if len(names) and names[-1] + 1 < len(names):
        name_of = np.zeros(n, np.int64)
        name_of[ordered] = names
        ordered = lms[_order_of_names(name_of[lms])]
    return _induce(s, smaller, ordered)


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position the common prefix with the suffix before it in order, up to ``most``.

    Lengths are found by halving steps over running hashes of ``data``.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    length = np.zeros(n, np.int64)
    known = np.flatnonzero(before >= 0)
    up, down = blocks.powers(n + 1)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(blocks.mix(data.astype(np.uint64) + np.uint64(1)) * up[:n], out=running[1:])
    step = 1 << (most.bit_length() - 1)
    while step:
        a, b = known + length[known], before[known] + length[known]
        fits = (np.maximum(a, b) + step <= n) & (length[known] + step <= most)
        i = np.flatnonzero(fits)
        a, b = a[i], b[i]
        same = (running[a + step] - running[a]) * down[a] == (running[b + step] - running[b]) * down[b]
        length[known[i[same]]] += step
        step >>= 1
    return length


def repeated_starts(data: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` values from each position also start elsewhere in ``data``.

    Values are below 1000; a run that holds a 0 is not looked at.
    """
    s = np.append(data.astype(np.int64) + 1, 0)
    order = suffix_array(s)
    common = permuted_common_prefixes(s, order, length)
    ranked = common[order] >= length
    found = ranked | np.append(ranked[1:], False)
    out = np.zeros(len(s), bool)
    out[order] = found
    return out[:-1]
