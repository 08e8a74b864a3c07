"""Vectorised text primitives shared by the operators: words, hashes and n-grams straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of anything but these bytes: \x20 and \x09-\x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, whatever the size of the batches that Spark sends; a longer row is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, before + max_bytes, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after the other, and where each row begins (one more for the end). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and for each row the number of its first word (one more for the end)."""
    gap = separator[data]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin, end = ~gap, ~gap
    if len(data):
        inner = gap[:-1].copy()
        inner[full[1:] - 1] = True  # a row's end ends its last word
        begin[1:] &= inner
        inner = gap[1:].copy()
        inner[full[1:] - 1] = True
        end[:-1] &= inner
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, read eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lane = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    out = size.astype(np.uint64) * _B
    live, at, left = np.arange(len(starts)), starts, size
    while len(live):
        keep = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(keep == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (keep * _U(8) % _U(64))) - _U(1))
        out[live] = mix(out[live] ^ (lane[at] & mask)) + _B
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def ngrams(values: np.ndarray, n: int) -> np.ndarray:
    """The hash of values[i:i+n] at each i; empty if there are fewer. Runs over all rows: the caller drops those that span two."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    power, span, have, out = values.astype(np.uint64) + _U(1), 1, 0, None
    base = int(_B)
    while True:  # doubling: H[a+b](i) = H[a](i) * B**b + H[b](i+a)
        if n & span:
            if out is None:
                out, have = power, span
            else:
                size = len(values) - have - span + 1
                out = out[:size] * _U(pow(base, span, 1 << 64)) + power[have : have + size]
                have += span
        if have == n:
            return mix(out)
        size = len(power) - span
        power = power[:size] * _U(pow(base, span, 1 << 64)) + power[span : span + size]
        span *= 2


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams over the concatenated rows lie in one row. first: each row's first token, and the end."""
    total = int(first[-1])
    keep = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):  # starts in the last n-1 tokens of a row reach into the next
        at = first[1:] - k
        at = at[(at >= first[:-1]) & (at < len(keep))]
        keep[at] = False
    return keep


def row_of(first: np.ndarray) -> np.ndarray:
    """Each token's row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of keys[i:i+w] at each i."""
    span = 1
    while span * 2 <= w:
        keys, span = np.minimum(keys[: len(keys) - span], keys[span:]), span * 2
    rest = w - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] of them), then those of the next."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.arange(total) + shift


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, which begin a new group."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal disjoint runs; touching runs are one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate([at[1:] - 1, [len(s) - 1]])]
