"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Over a small alphabet a bucket is induced at once: the suffixes before those
of a bucket are one array, in order, and their places are counted per symbol.
Over the names of the recursion, whose buckets hold one or two suffixes each,
the scan is the plain one.
"""

from __future__ import annotations

import numpy as np

from . import textops as T

#: Symbols up to which buckets are induced as arrays.
WIDE = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last, a lone smallest symbol, is."""
    n = len(s)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    rise[-1] = 1
    decided = np.where(rise != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(decided[::-1])[::-1]
    return rise[nearest] > 0


def _leftmost(small: np.ndarray) -> np.ndarray:
    out = np.zeros(len(small), bool)
    out[1:] = small[1:] & ~small[:-1]
    return np.flatnonzero(out)


def _placed(sa: np.ndarray, found: np.ndarray, symbols: np.ndarray, at: np.ndarray, step: int) -> None:
    """Puts suffixes, in order, at the open ends of their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.flatnonzero(np.append(True, sorted_symbols[1:] != sorted_symbols[:-1])) if len(order) else order
    counts = np.diff(np.append(first, len(order)))
    rank = np.arange(len(order)) - np.repeat(first, counts)
    sa[at[sorted_symbols] + step * rank] = found[order]
    at[sorted_symbols[first]] += step * counts


def _induce_wide(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(len(s), -1, np.int64)
    tails = ends - 1
    _placed(sa, lms[::-1], s[lms[::-1]], tails.copy(), -1)
    present = np.flatnonzero(sizes)
    heads = starts.copy()
    large = np.bincount(s[~small], minlength=len(sizes))
    for c in present.tolist():
        # The large suffixes of the bucket come in waves, each induced by the one before it.
        at = starts[c]
        while at < heads[c]:
            wave = sa[at : heads[c]]
            at = heads[c]
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            _placed(sa, before, s[before], heads, 1)
        rest = sa[starts[c] + large[c] : ends[c]]
        before = rest[rest > 0] - 1
        before = before[~small[before]]
        _placed(sa, before, s[before], heads, 1)
    # The small suffixes are induced anew, from the largest bucket down.
    tails = ends - 1
    for c in present[::-1].tolist():
        sa[starts[c] + large[c] : ends[c]] = -1
    if sizes[0]:
        sa[0] = len(s) - 1
    for c in present[::-1].tolist():
        at = ends[c] - 1
        while at > tails[c]:
            wave = sa[tails[c] + 1 : at + 1][::-1]
            at = tails[c]
            before = wave[wave > 0] - 1
            before = before[small[before]]
            _placed(sa, before, s[before], tails, -1)
        rest = sa[starts[c] : starts[c] + large[c]][::-1]
        before = rest[rest > 0] - 1
        before = before[small[before]]
        _placed(sa, before, s[before], tails, -1)
    return sa


def _induce_plain(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    text, kind = s.tolist(), small.tolist()
    ends = np.cumsum(sizes)
    heads, tails = (ends - sizes).tolist(), (ends - 1).tolist()
    sa = [-1] * len(text)
    for i in lms[::-1].tolist():
        c = text[i]
        sa[tails[c]] = i
        tails[c] -= 1
    for i in range(len(sa)):
        j = sa[i] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            sa[heads[c]] = j
            heads[c] += 1
    tails = (ends - 1).tolist()
    for i in range(len(sa) - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and kind[j]:
            c = text[j]
            sa[tails[c]] = j
            tails[c] -= 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes of non-negative integers that end with a 0 found nowhere else."""
    s = np.asarray(s)
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].astype(np.int64)
    sizes = np.bincount(s)
    induce = _induce_wide if len(sizes) <= WIDE else _induce_plain
    small = _types(s)
    lms = _leftmost(small)
    sa = induce(s, small, lms, sizes)
    mark = np.zeros(n, bool)
    mark[lms] = True
    ranked = sa[mark[sa]]
    # Names of the leftmost-smaller substrings, each from one such place to the next.
    stop = np.append(lms[1:], n - 1) + 1
    powers, inverse = T._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) * np.uint64(2) + small + np.uint64(1)) * powers[:n], out=sums[1:])
    key = T.mix((sums[stop] - sums[lms]) * inverse[lms])
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    keys = key[number[ranked]]
    names = np.zeros(len(lms), np.int64)
    names[number[ranked]] = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
    if len(lms) and names.max() + 1 < len(lms):
        order = suffix_array(names)
    else:
        order = np.argsort(names, kind="stable")
    return induce(s, small, lms[order], sizes)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """In text order: how much each suffix shares with the one before it in the suffix array, `most` at most."""
    n = len(s)
    powers, inverse = T._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((s.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    before = np.zeros(n, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    length = np.zeros(n, np.int64)
    step = 1 << max(most - 1, 1).bit_length()
    while step:
        a, b = here + length, before + length
        fits = np.flatnonzero((a + step <= n) & (b + step <= n) & (length + step <= most))
        a, b = a[fits], b[fits]
        same = (sums[a + step] - sums[a]) * inverse[a] == (sums[b + step] - sums[b]) * inverse[b]
        length[fits[same]] += step
        step >>= 1
    length[sa[0]] = 0
    return length
