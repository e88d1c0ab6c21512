"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` classifies every suffix as smaller (S) or larger (L) than the one after it, sorts
the leftmost-smaller (LMS) substrings by induction, names them, sorts the string of names by
recursion if a name occurs twice, and induces the order of all suffixes from that of the LMS
suffixes. Small alphabets are induced bucket by bucket with whole-array steps, which is linear; the
strings of names, whose alphabets are nearly as large as they are, a run of L or S suffixes at a time.

``common_prefixes`` compares each suffix with its predecessor in the array, in text order.
"""

from __future__ import annotations

import numpy as np

#: alphabets up to this size are induced a bucket at a time
SMALL_ALPHABET = 512


def is_smaller(s: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the next one; the last (the sentinel) is.

    A run of equal symbols has the type of its last symbol."""
    n = len(s)
    out = np.ones(n, bool)
    out[:-1] = s[:-1] < s[1:]
    last = np.ones(n, bool)
    last[:-1] = s[:-1] != s[1:]
    ends = np.flatnonzero(last)
    return out[ends[np.cumsum(last) - last]]


def leftmost(small: np.ndarray) -> np.ndarray:
    """Positions of S suffixes after an L suffix."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of all suffixes from an order of the LMS suffixes, a bucket at a time."""
    n, sigma = len(s), len(size)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int32)
    head = start.copy()
    by = s[lms]
    cut = np.searchsorted(by, np.arange(sigma + 1))  # LMS suffixes come ordered by first symbol
    for c in range(sigma):
        # L suffixes that smaller ones put here, those before them in a run, then the LMS suffixes
        at, waves = start[c], []
        while at < head[c]:
            wave = sa[at:head[c]]
            at = head[c]
            prev = wave - 1
            prev = prev[(prev >= 0) & ~small[prev]]
            same = prev[s[prev] == c]
            sa[at:at + len(same)] = same
            head[c] += len(same)
            waves.append(prev[s[prev] != c])
        prev = lms[cut[c]:cut[c + 1]] - 1
        waves.append(prev[prev >= 0])
        prev = np.concatenate(waves)
        if len(prev):
            ch = s[prev]
            order = np.argsort(ch, kind="stable")
            count = np.bincount(ch, minlength=sigma)
            first = np.cumsum(count) - count
            ch = ch[order]
            sa[head[ch] + np.arange(len(ch)) - first[ch]] = prev[order]
            head += count
    large_end, tail = head, end.copy()
    for c in range(sigma - 1, -1, -1):
        # from the right: S suffixes that larger ones put here, those before them in a run, then L suffixes
        at, waves = end[c], []
        while at > tail[c]:
            wave = sa[tail[c]:at][::-1]
            at = tail[c]
            prev = wave - 1
            prev = prev[(prev >= 0) & small[prev]]
            same = prev[s[prev] == c]
            sa[at - len(same):at] = same[::-1]
            tail[c] -= len(same)
            waves.append(prev[s[prev] != c])
        prev = sa[start[c]:large_end[c]][::-1] - 1
        prev = prev[prev >= 0]
        waves.append(prev[small[prev]])
        prev = np.concatenate(waves)
        if len(prev):
            ch = s[prev]
            order = np.argsort(ch, kind="stable")
            count = np.bincount(ch, minlength=sigma)
            first = np.cumsum(count) - count
            ch = ch[order]
            sa[tail[ch] - 1 - (np.arange(len(ch)) - first[ch])] = prev[order]
            tail -= count
        if c == 0:
            sa[0] = n - 1  # the sentinel
    return sa


def _order(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by high, then low, whether each in that order differs from the one before it); both below ``most``."""
    n = len(high)
    bits = int(most).bit_length()
    place = max(n - 1, 1).bit_length()
    if 2 * bits + place <= 63:  # sorting values is several times faster than sorting indices
        key = np.sort((high << (bits + place)) | (low << place) | np.arange(n))
        order, key = key & ((1 << place) - 1), key >> place
    else:
        order = np.lexsort((low, high))
        key = high[order] * most + low[order] if 2 * bits <= 62 else None
        if key is None:
            return order, np.append(True, (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0))[:n]
    return order, np.append(True, key[1:] != key[:-1])[:n]


def _ranks(high: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """Dense ranks by high, then low; equal ones alike."""
    order, fresh = _order(high, low, most)
    out = np.empty(len(high), np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


def _sort_runs(low: np.ndarray, s: np.ndarray, at: np.ndarray, stop: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes ``at``, whose runs end at the positions ``stop`` of final rank.

    ``low`` orders those of one first symbol, ends finally. What a run's suffixes are induced
    from lies 1, 2, 4, ... places on, so the rounds are the logarithm of the longest run.
    ``slot`` is scratch space: the place of a position in ``at``."""
    slot[at] = np.arange(len(at))
    most = len(s) + 2
    rank, step, longest = _ranks(s[at].astype(np.int64), low, most), 1, int((stop - at).max(initial=0))
    while step <= longest:
        ahead = slot[np.minimum(at + step, stop)]
        rank = _ranks(rank, rank[ahead], most)
        step *= 2
    return rank


def _induce_runs(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for large alphabets: all runs of L suffixes from the LMS suffix that ends each, then
    all runs of S suffixes from the L suffix that ends each."""
    n = len(s)
    slot = np.zeros(n, np.int64)
    large = np.flatnonzero(~small)
    sa = np.empty(n, np.int32)
    order = np.zeros(n, np.int64)  # of LMS suffixes, later of L suffixes
    order[lms] = np.arange(len(lms))
    ends = np.sort(lms)
    at = np.concatenate((large, ends))
    stop = np.concatenate((ends[np.searchsorted(ends, large)] if len(large) else large, ends))
    low = np.zeros(len(at), np.int64)
    low[len(large):] = 1 + order[ends]  # an L suffix comes before an S suffix of the same first symbol
    rank = _sort_runs(low, s, at, stop, slot)
    by_rank = np.full(len(at), -1, np.int64)
    by_rank[rank[:len(large)]] = large
    large = by_rank[by_rank >= 0]
    order[large] = np.arange(len(large))
    smaller = np.flatnonzero(small)
    ends = np.append(np.sort(large), n - 1)
    at = np.concatenate((smaller[:-1], ends))
    stop = np.concatenate((ends[np.searchsorted(ends, smaller[:-1])], ends))
    low = np.full(len(at), n, np.int64)
    low[len(smaller) - 1:-1] = order[ends[:-1]]
    low[-1] = 0  # the sentinel
    rank = _sort_runs(low, s, at, stop, slot)
    sa[rank] = at
    return sa


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each LMS substring (in text order) and the number of different ones."""
    n = len(s)
    length = np.zeros(n, np.int32)
    length[lms] = np.append(np.diff(lms), 1)  # up to and without the next LMS position, which is compared too
    a, b = ordered[:-1], ordered[1:]
    differ = length[a] != length[b]
    live = np.flatnonzero(~differ)
    off = 0
    while len(live):
        unequal = s[a[live] + off] != s[b[live] + off]
        differ[live[unequal]] = True
        live = live[~unequal]
        off += 1
        live = live[(off <= length[a[live]]) & (b[live] + off < n) & (a[live] + off < n)]
    rank = np.zeros(n, np.int32)
    rank[ordered] = np.concatenate(([0], np.cumsum(differ)))
    return rank[lms], int(differ.sum()) + 1


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Sorted suffixes of ``s``, symbols 0 to sigma - 1, whose last symbol is its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    size = np.bincount(s, minlength=sigma)
    induce = _induce_buckets if sigma <= SMALL_ALPHABET else _induce_runs
    small = is_smaller(s)
    lms = leftmost(small)
    first = induce(s, small, lms[np.argsort(s[lms], kind="stable")], size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    names, different = _names(s, lms, ordered)
    if different < len(lms):
        ordered = lms[suffix_array(names, different)]
    return induce(s, small, ordered, size)


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, pick: np.ndarray | None = None) -> np.ndarray:
    """Permuted common prefixes: for each suffix in text order, the bytes it shares with its
    predecessor in ``sa``, counted up to ``most``. ``data`` are the bytes, ``len(sa)`` of them. With a
    mask ``pick``, only picked suffixes with picked predecessors are compared; others count 0."""
    n = len(sa)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = data
    words = np.zeros(n + most + 8, np.uint64)  # 8 bytes from every position
    for k in range(8):
        words |= padded[k:k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    out = np.zeros(n, np.int32)
    live = np.flatnonzero(before >= 0 if pick is None else pick & (before >= 0) & pick[before])
    at = before[live]
    for off in range(0, most, 8):
        x = words[live + off] ^ words[at + off]
        low = x & (~x + np.uint64(1))  # lowest set bit
        equal = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int32))
        room = n - np.maximum(live, at) - off  # a suffix ends at the end of the data
        out[live] += np.minimum(equal, np.maximum(room, 0)).astype(np.int32)
        on = x == 0
        live, at = live[on], at[on]
    return np.minimum(out, most)
