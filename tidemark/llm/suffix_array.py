"""Suffix arrays by induced sorting, and permuted common prefixes, in NumPy.

Induced sorting after Nong, Zhang and Chan (2009): suffixes are classed as smaller (S) or
larger (L) than their right neighbour; leftmost S suffixes are sorted by their substrings,
recursively by the names of these where names repeat; all others are induced from them, L
suffixes bucket by bucket from the left, S suffixes from the right. A bucket is handled in
whole arrays: what a part of it induces goes to the ends of later buckets in stable order, and
to its own end only after that part, so each pass takes linear time.
"""

from __future__ import annotations

import numpy as np

#: A reduced string with more names than one in so many symbols is sorted by doubling, the base of the recursion.
NAMES_SHARE = 16


def _spread(rows: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends rows to the buckets of their characters, in order."""
    if len(rows) == 1:
        into[chars[0]].append(rows)
        return
    order = np.argsort(chars, kind="stable")
    rows, chars = rows[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
        into[chars[a]].append(rows[a:b])


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from leftmost S suffixes in order (or only roughly, for their substrings)."""
    large: list[list[np.ndarray]] = [[] for _ in range(size)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    small: list[list[np.ndarray]] = [[] for _ in range(size)]
    if len(lms):
        _spread(lms, text[lms], seeds)

    def push(rows: np.ndarray, want_s: bool, into: list[list[np.ndarray]]) -> None:
        left = rows - 1
        left = left[left >= 0]
        left = left[is_s[left] == want_s]
        if len(left):
            _spread(left, text[left], into)

    # the end of the text is smaller than everything: its left neighbour is the first L suffix induced
    last = len(text) - 1
    large[text[last]].append(np.array([last]))
    for c in range(size):
        done = 0
        while done < len(large[c]):
            part, done = large[c][done:], len(large[c])
            push(np.concatenate(part), False, large)
        if seeds[c]:
            push(np.concatenate(seeds[c]), False, large)
    for c in range(size - 1, -1, -1):
        done = 0
        while done < len(small[c]):
            part, done = small[c][done:], len(small[c])
            push(np.concatenate(part), True, small)
        if large[c]:
            push(np.concatenate(large[c])[::-1], True, small)
    parts: list[np.ndarray] = []
    for c in range(size):
        parts += large[c]
        if small[c]:
            parts.append(np.concatenate(small[c])[::-1])
    return np.concatenate(parts)


def _doubling(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling the compared length."""
    rank, n, h = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, len(text), 1
    while True:
        second = np.zeros(n, np.int64)
        if h < n:
            second[:-h] = rank[h:]
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1]))) + 1
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            return order
        h *= 2


def _classes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """is_s for each suffix, and the leftmost S positions."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])  # where a suffix's first difference to its neighbour is at once
    at = np.searchsorted(change, np.arange(n))
    known = at < len(change)
    is_s = np.zeros(n, bool)  # a run that ends the text is L, as the end is smaller than everything
    first = change[at[known]]
    is_s[known] = text[first] < text[first + 1]
    return is_s, np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _names(text: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the leftmost S substrings, given in the order of their substrings; equal ones share a name."""
    end = np.empty(len(text), np.int64)
    end[lms] = np.concatenate((lms[1:], [len(text)]))  # a substring runs to the next one's first symbol, that included
    a, b = order[:-1], order[1:]
    length = end[a] - a
    differ = length != (end[b] - b)
    active = np.flatnonzero(~differ)
    padded = np.concatenate((text, [-1]))
    step = 0
    while len(active):
        other = padded[a[active] + step] != padded[b[active] + step]
        differ[active[other]] = True
        active = active[~other]
        step += 1
        active = active[length[active] >= step]
    return np.concatenate(([0], np.cumsum(differ)))


def suffix_array(text: np.ndarray, size: int | None = None) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (integers from 0 below ``size``) in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    size = int(text.max()) + 1 if size is None else size
    is_s, lms = _classes(text)
    if not len(lms):
        return _induce(_compact(text, size), is_s, lms, size)
    small = _compact(text, size)
    order = _induce(small, is_s, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    names = _names(text, order, lms)
    count = int(names[-1]) + 1
    if count < len(lms):
        reduced = np.empty(n, np.int64)
        reduced[order] = names
        reduced = reduced[lms]
        inner = suffix_array(reduced, count) if count * NAMES_SHARE <= len(reduced) else _doubling(reduced)
        order = lms[inner]
    return _induce(small, is_s, order, size)


def _compact(text: np.ndarray, size: int) -> np.ndarray:
    """In the narrowest type, for which a stable sort is a radix sort."""
    return text.astype(np.uint8 if size <= 256 else np.uint16 if size <= 65536 else np.int64)


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the common prefix of its suffix and the one before it in order (Karkkainen, Manzini and Puglisi, 2009).

    Where the symbols to the left agree, the value is one less than the left neighbour's; only
    the other positions are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    left_same = np.zeros(n, bool)
    at = np.arange(1, n)
    ok = (before[1:] > 0) & (before[:-1] >= 0)
    left_same[1:][ok] = text[at[ok] - 1] == text[before[1:][ok] - 1]
    # reducible only if the left neighbour's predecessor is this one's predecessor's left neighbour
    left_same[1:] &= before[:-1] == before[1:] - 1
    own = np.flatnonzero(~left_same)
    value = np.zeros(n, np.int64)
    active = own[before[own] >= 0]
    padded = np.concatenate((text.astype(np.int32), np.full(1, -1, np.int32)))
    step = 0
    while len(active):
        x, y = active + step, before[active] + step
        inside = (x < n) & (y < n)
        active, x, y = active[inside], x[inside], y[inside]
        same = padded[x] == padded[y]
        active = active[same]
        step += 1
        value[active] = step
    last = np.zeros(n, np.int64)
    last[own] = own
    last = np.maximum.accumulate(last)
    return np.maximum(value[last] + last - np.arange(n), 0) * (before >= 0)
