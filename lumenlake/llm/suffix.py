"""Suffix arrays by induced sorting, and permuted common prefixes, as whole-array operations.

The scheme is that of induced sorting: classify suffixes as larger (L) or smaller (S) than their successor; sort the
leftmost-smaller (LMS) substrings by inducing from LMS positions that are ordered by symbol only; name them; sort the
reduced string of names by the same function; induce the whole order from the sorted LMS suffixes.

Bytes are induced bucket by bucket: what a bucket induces is appended to its buckets at once, and a bucket that induces
into itself is scanned in waves, so a level takes linear time. Reduced strings have many symbols and short runs between LMS
positions. There the induced order is taken in closed form: an L suffix is ordered by its symbols up to the next LMS
position and by the order there, an S suffix by its symbols up to the next L suffix and by the order there; at equal
symbols L comes before S. Doubling along these runs takes as many rounds as the longest run has bits.
"""

from __future__ import annotations

import numpy as np

from ._arrow import ranges


def _types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S. The last is L, as the empty suffix is the least."""
    out = np.zeros(len(text), bool)
    out[:-1] = text[:-1] < text[1:]
    same = np.flatnonzero(text[:-1] == text[1:])
    if len(same):  # a run of equal symbols has the type of its last
        last = np.arange(len(text))
        last[same] = len(text)
        out = out[np.minimum.accumulate(last[::-1])[::-1]]
    return out


def _lms(is_s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _append(free: np.ndarray, out: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray) -> None:
    """Put suffixes, in order, at the next free places of their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")
    count = np.bincount(symbols, minlength=256)
    some = np.flatnonzero(count)
    out[ranges(free[some], count[some])] = suffixes[order]
    free += count


def _induce_bytes(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order from the LMS suffixes in order (or, if those are only ordered by symbol, in the order of what follows up to the next LMS position)."""
    n = len(text)
    start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])
    lms_of = np.searchsorted(text[lms], np.arange(257))
    left = np.full(n, -1, np.int64)
    free = start[:-1].copy()
    _append(free, left, text[-1:], np.array([n - 1]))  # induced by the empty suffix
    for c in np.unique(text).tolist():
        done = start[c]
        while done < free[c]:
            wave = left[done : free[c]]
            done = free[c]
            before = wave[wave > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _append(free, left, text[before], before)
        own = lms[lms_of[c] : lms_of[c + 1]]
        if len(own):  # before an LMS suffix is an L suffix
            _append(free, left, text[own - 1], own - 1)
    right = np.full(n, -1, np.int64)  # mirrored: S suffixes from the end of each bucket
    back = n - start[1:]
    first = back.copy()
    for c in np.unique(text)[::-1].tolist():
        done = first[c]
        while done < back[c]:
            wave = right[done : back[c]]
            done = back[c]
            before = wave[wave > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _append(back, right, text[before], before)
        own = left[start[c] : free[c]][::-1]
        before = own[own > 0] - 1
        before = before[is_s[before]]
        if len(before):
            _append(back, right, text[before], before)
    return np.where(left < 0, right[::-1], left)


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1]


def _along(code: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranks of the strings code[i], code[i+1], ... that stop at the first place where end is set; equal strings have equal ranks."""
    n = len(code)
    rank, jump, stopped = code, np.minimum(np.arange(n) + 1, n - 1), end.copy()
    stopped[-1] = True
    while True:
        further = np.where(stopped, 0, rank[jump] + 1)
        rank = _dense(rank, further)
        after = stopped | stopped[jump]
        if stopped.all() or int(rank.max()) == n - 1:
            return rank
        jump, stopped = np.where(stopped, jump, jump[jump]), after


def _induce_names(text: np.ndarray, is_s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes from those of the LMS suffixes; order: their ranks from 1 (equal ones stay equal), 0 elsewhere."""
    symbol = text * 2 + is_s
    l_rank = _along(_dense(symbol, order), is_s)
    s_rank = _along(_dense(symbol, np.where(is_s, 0, l_rank + 1)), ~is_s)
    return _dense(symbol, np.where(is_s, s_rank, l_rank))


def _names(text: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string over many symbols."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    is_s = _types(text)
    lms = _lms(is_s)
    order = np.zeros(n, np.int64)
    if len(lms):
        name = _induce_names(text, is_s, order)[lms]
        kinds, name = np.unique(name, return_inverse=True)
        order[lms] = (name if len(kinds) == len(lms) else _names(name)) + 1
    return _induce_names(text, is_s, order)


def _lanes(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))


def _equal(lanes: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[a:a+size] and text[b:b+size] are the same."""
    out, live, done = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        left = np.minimum(size[live] - done, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        same = (lanes[a[live] + done] ^ lanes[b[live] + done]) & mask == 0
        out[live[~same]] = False
        live, done = live[same], done + 8
        live = live[size[live] > done]
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of bytes in order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    is_s = _types(text)
    lms = _lms(is_s)
    if not len(lms):
        return _induce_bytes(text, is_s, lms)
    some = _induce_bytes(text, is_s, lms[np.argsort(text[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    some = some[is_lms[some]]  # LMS substrings in order
    place = np.zeros(n, np.int64)
    place[lms] = np.arange(len(lms))
    size = np.append(np.diff(lms) + 1, n - lms[-1] + 1)[place[some]]  # the last one ends in the empty suffix, as no other does
    same = size[1:] == size[:-1]
    at = np.flatnonzero(same & (some[1:] != lms[-1]) & (some[:-1] != lms[-1]))
    same[:] = False
    same[at] = _equal(_lanes(text), some[at], some[at + 1], size[at])
    name = np.empty(len(lms), np.int64)
    name[place[some]] = np.cumsum(np.concatenate([[0], ~same]))
    if same.any():
        name = _names(name)
    ordered = np.empty(len(lms), np.int64)
    ordered[name] = lms
    return _induce_bytes(text, is_s, ordered)


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, how many bytes it shares with the one before it in sa (0 for the first).

    Where the bytes before the two differ, the prefix is compared; elsewhere it is one less than that of the suffix
    one byte before, so a running maximum of ends fills it in.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (phi > 0) & (i > 0)
    reducible[reducible] = text[i[reducible] - 1] == text[phi[reducible] - 1]
    at = np.flatnonzero(~reducible & (phi >= 0))
    lanes, size = _lanes(text), np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        a, b = at[live] + size[live], phi[at[live]] + size[live]
        room = np.minimum(n - np.maximum(a, b), 8)
        x = lanes[a] ^ lanes[b]
        low = x & (~x + np.uint64(1))  # the lowest differing bit
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        same = np.minimum(same, room)
        size[live] += same
        live = live[(same == 8) & (np.maximum(a, b) + 8 < n)]
    end = np.zeros(n, np.int64)
    end[at] = size + at
    return np.maximum(np.maximum.accumulate(end) - i, 0)
