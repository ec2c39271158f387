"""Suffix array of one shard by induced sorting, and its permuted longest common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order; its last sign is 0 and stands nowhere else.

    Suffixes are classified as smaller (S) or larger (L) than the next. The leftmost S suffixes of
    each run are sorted: their substrings by inducing from an arbitrary order, and, where
    substrings are equal, the string of their names. Everything else is induced from them, bucket
    by bucket. A bucket is induced in waves: all entries known so far at once.
    """
    n = len(text)
    small = _classify(text)
    lms = np.flatnonzero(small & np.r_[False, ~small[:-1]])
    sizes = np.bincount(text, minlength=int(text.max()) + 1)
    order = _induce(text, small, lms[np.argsort(text[lms], kind="stable")], sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    names = _names(text, order, lms)
    name_of = np.zeros(n, np.int64)
    name_of[order] = names
    ranks = _sorted_names(name_of[lms])
    return _induce(text, small, lms[ranks], sizes)


def _classify(text: np.ndarray) -> np.ndarray:
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    following = differs[np.searchsorted(differs, np.arange(n - 1))] if len(differs) else np.zeros(0, np.int64)
    small = np.ones(n, bool)
    small[:-1] = text[following] < text[following + 1]
    return small


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of the leftmost S suffixes, given by first sign."""
    n, signs = len(text), len(sizes)
    order = np.empty(n, np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    lms_to = np.searchsorted(text[lms], np.arange(signs), side="right")

    def place(found: np.ndarray, step: int, free: np.ndarray) -> None:
        """Put suffixes into the next free places of their buckets, in order."""
        sign = text[found]
        by = np.argsort(sign, kind="stable")
        sign = sign[by]
        count = np.bincount(sign, minlength=signs)
        within = np.arange(len(by)) - (np.cumsum(count) - count)[sign]
        order[free[sign] + step * within] = found[by]
        free += step * count

    free = starts.copy()
    for c in np.flatnonzero(sizes):
        at = starts[c]
        while at < free[c]:
            wave, at = order[at : free[c]], free[c]
            wave = wave[wave > 0] - 1
            place(wave[~small[wave]], 1, free)
        wave = lms[(lms_to[c - 1] if c else 0) : lms_to[c]]
        wave = wave[wave > 0] - 1
        place(wave[~small[wave]], 1, free)
    larger = free
    free = ends - 1
    for c in np.flatnonzero(sizes)[::-1]:
        at = ends[c] - 1
        while at > free[c]:
            wave, at = order[free[c] + 1 : at + 1][::-1], free[c]
            wave = wave[wave > 0] - 1
            place(wave[small[wave]], -1, free)
        wave = order[starts[c] : larger[c]][::-1]
        wave = wave[wave > 0] - 1
        place(wave[small[wave]], -1, free)
    order[0] = n - 1
    return order


def _names(text: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Numbers of the substrings from each leftmost S suffix to the next, equal ones alike."""
    size = np.zeros(len(text), np.int64)
    size[lms] = np.r_[np.diff(lms), 0] + 1
    same = size[order[1:]] == size[order[:-1]]
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        a, b = order[left], order[left + 1]
        equal = text[a + step] == text[b + step]
        same[left[~equal]] = False
        step += 1
        left = left[equal & (size[a] > step)]
    return np.cumsum(np.r_[0, ~same])


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of numbers, by ranks of prefixes twice as long each time.

    The alphabet is nearly as large as the string here, too large to induce bucket by bucket.
    """
    n, rank, width = len(names), names.astype(np.int64), 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + following
        by = np.argsort(key, kind="stable")
        new = np.cumsum(np.r_[0, np.diff(key[by]) != 0])
        rank[by] = new
        if n == 0 or new[-1] == n - 1:
            return by
        width *= 2


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position: the common prefix with the suffix before it in order, and that suffix.

    Where the signs before both are equal, the value is that of the position to the left less one;
    only the others are compared.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    at = np.arange(n)
    root = (at == 0) | (before <= 0)
    rest = np.flatnonzero(~root)
    root[rest] = text[rest - 1] != text[before[rest] - 1]
    left = np.flatnonzero(root & (before >= 0))
    wide = text.astype(np.uint64)
    four = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)
    lcp = np.zeros(n, np.int64)
    while len(left):
        a, b = left + lcp[left], before[left] + lcp[left]
        equal = np.maximum(a, b) < len(four)
        equal[equal] = four[a[equal]] == four[b[equal]]
        lcp[left[equal]] += 4
        short, left = left[~equal], left[equal]
        while len(short):  # at most three signs more
            a, b = short + lcp[short], before[short] + lcp[short]
            fits = np.maximum(a, b) < n
            short, a, b = short[fits], a[fits], b[fits]
            short = short[text[a] == text[b]]
            lcp[short] += 1
    roots = np.flatnonzero(root)
    last = roots[np.searchsorted(roots, at, side="right") - 1]
    return np.maximum(lcp[last] - (at - last), 0), before

