"""Suffix arrays by induced sorting and their permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes, sorts leftmost-smaller (LMS) substrings by induction, names them,
sorts the string of names by itself and induces the whole order from it.  An induction handles a
bucket at a time with array operations, or, where symbols are many and buckets small (as in strings of names), a
suffix at a time; every suffix is placed once.
"""

from __future__ import annotations

import numpy as np

#: From this many suffixes a symbol on, a bucket is worth an array operation; below it suffixes are induced one at a time.
DENSE = 64


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is a unique least sentinel."""
    n = len(s)
    differs = np.append(s[:-1] != s[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(s[:-1] < s[1:], True)
    return smaller[at]


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that follows from the given order of LMS suffixes."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=k))))
    head, tail = bounds[:-1].copy(), bounds[1:].copy()
    of_lms = s[lms]
    order = np.argsort(of_lms, kind="stable")
    lms_sorted = lms[order]
    lms_bounds = np.concatenate(([0], np.cumsum(np.bincount(of_lms, minlength=k))))

    def place(j: np.ndarray, up: bool) -> None:
        c = s[j]
        if len(j) > 1:
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o]
        cuts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        sizes = np.diff(np.append(cuts, len(c)))
        within = np.arange(len(c)) - np.repeat(cuts, sizes)
        kinds = c[cuts]
        if up:
            sa[np.repeat(head[kinds], sizes) + within] = j
            head[kinds] += sizes
        else:
            sa[np.repeat(tail[kinds], sizes) - 1 - within] = j
            tail[kinds] -= sizes

    used = np.flatnonzero(np.diff(bounds))
    for c in used:
        done = bounds[c]
        while done < head[c]:
            j = sa[done : head[c]] - 1
            done = head[c]
            j = j[j >= 0]
            j = j[~smaller[j]]
            if len(j):
                place(j, True)
        a, b = lms_bounds[c], lms_bounds[c + 1]
        if a < b:
            j = lms_sorted[a:b] - 1
            j = j[j >= 0]
            if len(j):
                place(j, True)
    for c in used[::-1]:
        if c == 0:
            break
        done = bounds[c + 1]
        while done > tail[c]:
            j = sa[tail[c] : done][::-1] - 1
            done = tail[c]
            j = j[j >= 0]
            j = j[smaller[j]]
            if len(j):
                place(j, False)
        j = sa[bounds[c] : head[c]][::-1] - 1
        j = j[j >= 0]
        j = j[smaller[j]]
        if len(j):
            place(j, False)
    sa[0] = n - 1
    return sa


def induce_singly(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same order for strings of many symbols: two linear passes that place one suffix at a time."""
    bounds = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=k))))
    order = np.argsort(s[lms], kind="stable")
    placed = lms[order]
    c = s[placed]
    counts = np.bincount(c, minlength=k)
    within = np.arange(len(placed)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.full(len(s), -1, np.int64)
    start[bounds[1:][c] - counts[c] + within] = placed
    # for each suffix the bucket of the one before it, if that is of the kind that a pass places; no suffix is -1
    before = np.full((2, len(s) + 1), -1, np.int64)
    for kind in (0, 1):
        of = np.flatnonzero(smaller[:-1] == bool(kind))
        before[kind, of + 1] = s[of]
    larger, less = before.tolist()
    sa, head, tail = start.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()
    for j in sa:  # what is placed ahead is met later
        c = larger[j]
        if c >= 0:
            sa[head[c]] = j - 1
            head[c] += 1
    for j in reversed(sa):
        c = less[j]
        if c >= 0:
            at = tail[c] - 1
            tail[c] = at
            sa[at] = j - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols from 0 on, of which 0 stands only at the end."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable") if n else np.zeros(0, np.int64)
    k = int(s.max()) + 1
    induced = induce if n >= DENSE * k else induce_singly
    smaller = classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = induced(s, smaller, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = sa[is_lms[sa]]
    ends = np.zeros(n, np.int64)
    ends[lms] = np.append(lms[1:], n - 1)
    a, b = by_substring[:-1], by_substring[1:]
    same = ends[a] - a == ends[b] - b
    alive, d = np.flatnonzero(same), 0
    while len(alive):
        x, y = a[alive] + d, b[alive] + d
        equal = s[x] == s[y]
        same[alive[~equal]] = False
        alive = alive[equal & (x < ends[a[alive]])]
        d += 1
    names = np.zeros(n, np.int64)
    names[by_substring] = np.cumsum(np.append(0, ~same))
    reduced = names[lms]
    distinct = int(reduced.max()) + 1
    order = by_substring if distinct == len(lms) else lms[suffix_array(reduced)]
    return induced(s, smaller, order, k)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """PLCP: for each place, the common prefix with the suffix before it in order, up to ``most`` symbols."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    bits = 8 if s.max() < 256 else 16  # as many symbols to a 64-bit word as fit
    per = 64 // bits
    padded = np.zeros(n + most + 2 * per, np.uint64)
    padded[:n] = s
    wide = np.zeros(n + most + per, np.uint64)
    for j in range(per):
        wide |= padded[j : j + len(wide)] << np.uint64(bits * j)
    plcp = np.zeros(n, np.int32)
    alive, d = np.flatnonzero(before >= 0), 0
    other = before[alive]
    while len(alive) and d < most:
        differ = wide[alive + d] ^ wide[other + d]
        stop = np.flatnonzero(differ)
        if len(stop):
            x = differ[stop]
            equal = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // bits  # symbols below the lowest bit that differs
            plcp[alive[stop]] = np.minimum(d + equal.astype(np.int32), most)
            go = differ == 0
            alive, other = alive[go], other[go]
        d += per
    plcp[alive] = most
    return plcp
