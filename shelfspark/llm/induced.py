"""Suffix array of a shard by induced sorting, and permuted common prefixes.

Suffixes are classified S (smaller than the next suffix) or L (larger); the
leftmost S of each run is a sample (LMS). A first induction sorts the substrings from sample to
sample, equal ones get equal names, and the string of names, at most half as
long, is sorted recursively. A second induction extends the samples' order to all
suffixes in linear time. An induction walks the symbols' buckets in order; all entries of a bucket
that are known are handled in one numpy step, their left neighbours being
appended to their own buckets in the same order.

Walking buckets pays while symbols are few. A string of names has nearly as
many symbols as positions; there the recursion ends and the few positions whose names
repeat are told apart by doubling their ranks.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; ``t`` ends in a unique least symbol."""
    n = len(t)
    rise = t[1:] > t[:-1]
    far = np.where(t[1:] != t[:-1], np.arange(n - 1), n)
    return np.append(rise[np.minimum.accumulate(far[::-1])[::-1]], True)


def _deal(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, the symbols so ordered, each one's number among equals, and counts."""
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    count = np.bincount(ordered, minlength=width)
    return order, ordered, np.arange(len(ordered)) - (np.cumsum(count) - count)[ordered], count


def _induce(t: np.ndarray, s_type: np.ndarray, samples: np.ndarray, width: int) -> np.ndarray:
    """Suffix array induced from samples in the given order (a stable order within each bucket)."""
    sa = np.full(len(t), -1, dtype=np.int64)
    size = np.bincount(t, minlength=width)
    end = np.cumsum(size)
    start = end - size
    order, symbol, number, count = _deal(t[samples], width)
    first = end - count
    sa[first[symbol] + number] = samples[order]
    used = np.flatnonzero(size).tolist()

    head = start.copy()

    def left(block: np.ndarray) -> None:
        j = block - 1
        j = j[j >= 0]
        j = j[~s_type[j]]
        if len(j):
            order, symbol, number, count = _deal(t[j], width)
            sa[head[symbol] + number] = j[order]
            np.add(head, count, out=head)

    for c in used:
        low = start[c]
        while low < head[c]:
            high = head[c]
            left(sa[low:high])
            low = high
        if count[c]:
            left(sa[first[c]:end[c]])

    tail = end.copy()

    def right(block: np.ndarray) -> None:
        j = block[::-1] - 1
        j = j[j >= 0]
        j = j[s_type[j]]
        if len(j):
            order, symbol, number, count = _deal(t[j], width)
            sa[tail[symbol] - 1 - number] = j[order]
            np.subtract(tail, count, out=tail)

    for c in reversed(used):
        high = end[c]
        while tail[c] < high:
            low = tail[c]
            right(sa[low:high])
            high = low
        if head[c] > start[c]:
            right(sa[start[c]:head[c]])
    sa[0] = len(t) - 1
    return sa


def _names(t: np.ndarray, samples: np.ndarray, by_order: np.ndarray) -> np.ndarray:
    """Rank of the substring from each sample to the next (equal substrings alike), in text order."""
    size = np.diff(np.append(samples, len(t)))  # up to and without the next sample
    place = np.empty(len(t), dtype=np.int64)
    place[samples] = np.arange(len(samples))
    a, b = by_order[:-1], by_order[1:]
    length = size[place[a]]
    equal = length == size[place[b]]
    active = np.flatnonzero(equal)
    at = 0
    while len(active):  # the next sample's own symbol is compared too
        other = t[a[active] + at] != t[np.minimum(b[active] + at, len(t) - 1)]
        equal[active[other]] = False
        active = active[~other]
        active = active[length[active] > at]
        at += 1
    out = np.empty(len(samples), dtype=np.int64)
    out[place[by_order]] = np.concatenate(([0], np.cumsum(~equal)))
    return out


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of many symbols: only positions not yet told apart are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of its equals
    alone = np.append(new[1:], True) & new
    active = order[~alone]
    step = 1
    while len(active):
        key = rank[active] * np.int64(n + 1) + np.where(active + step < n, rank[np.minimum(active + step, n - 1)] + 1, 0)
        by = np.argsort(key)
        active, key = active[by], key[by]
        old = rank[active]
        k = np.arange(len(active))
        first_old = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), k, 0))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[active] = old + np.maximum.accumulate(np.where(new, k, 0)) - first_old
        active = active[~(new & np.append(new[1:], True))]
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(t: np.ndarray, width: int) -> np.ndarray:
    """Suffix array of symbols 0 .. width - 1; the last symbol is 0 and occurs once."""
    if width > 1 << 16 or width * 256 > len(t):
        return _by_doubling(t)
    t = t.astype(np.uint16)  # numpy sorts 16-bit symbols by radix
    s_type = _types(t)
    samples = np.flatnonzero(np.concatenate(([False], s_type[1:] & ~s_type[:-1])))
    is_sample = np.zeros(len(t), dtype=bool)
    is_sample[samples] = True
    sa = _induce(t, s_type, samples, width)
    names = _names(t, samples, sa[is_sample[sa]])
    ordered = samples[suffix_array(names, int(names.max()) + 1)]
    return _induce(t, s_type, ordered, width)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number (zeros past the end)."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    out = padded[:-7].copy()
    for k in range(1, 8):
        out = (out << np.uint64(8)) | padded[k:len(padded) - 7 + k]
    return out[:len(data)]


def _common(words: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that the suffixes i and j have in common, up to ``limit``."""
    out = np.full(len(i), limit, dtype=np.int64)
    active = np.arange(len(i))
    last = len(words) - 1
    for at in range(0, limit, 8):
        a, b = words[np.minimum(i[active] + at, last)], words[np.minimum(j[active] + at, last)]
        diff = a ^ b
        ended = np.flatnonzero(diff)
        if len(ended):
            d = diff[ended]
            same = sum((d < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
            out[active[ended]] = at + same
            active = active[diff == 0]
            if not len(active):
                break
    return np.minimum(out, limit)


def repeated_starts(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment, the starts of its ``width``-byte strings found at another start of any segment."""
    gap = bytes(8)
    text = gap.join(segments) + gap
    data = np.frombuffer(text, dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    firsts = np.concatenate(([0], np.cumsum(sizes + 8)[:-1]))
    counts = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(segments)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + firsts[owner]
    if len(starts) < 2:
        return [np.empty(0, np.int64) for _ in segments]

    words = _words(data)
    symbols = np.append(data.astype(np.int64) + 2, 0)
    for k in range(8):
        symbols[firsts + sizes + k] = 1  # the gaps
    is_start = np.zeros(len(symbols), dtype=bool)
    is_start[starts] = True
    order = suffix_array(symbols, 258)
    order = order[is_start[order]]

    # Permuted common prefixes: while a suffix and its predecessor both move on by one equal byte,
    # the prefix they share shrinks by one; only where that ends is it measured anew.
    before = np.full(len(symbols) + 1, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    phi = before[starts]
    follows = np.zeros(len(starts), dtype=bool)
    follows[1:] = (np.diff(starts) == 1) & (phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0)
    follows[1:] &= data[starts[:-1]] == data[np.maximum(phi[:-1], 0)]
    own = np.flatnonzero(~follows)
    reach = int(sizes.max())
    value = _common(words, starts[own], np.maximum(phi[own], 0), reach)
    value[phi[own] < 0] = 0
    run = np.cumsum(~follows) - 1
    plcp = np.zeros(len(symbols) + 1, dtype=np.int64)
    plcp[starts] = value[run] - (starts - starts[own][run])

    shared = plcp[order]
    found = np.zeros(len(symbols), dtype=bool)
    same = shared >= width
    found[order[same]] = True
    found[order[np.flatnonzero(same) - 1]] = True
    flags = found[starts]
    edges = np.cumsum(counts)
    return [np.flatnonzero(flags[b - c:b]) for b, c in zip(edges.tolist(), counts.tolist())]
