"""Repeated windows found through winnowed seeds, for tokens of any kind (words, bytes).

A window of W tokens has a seed: its k-gram of least hash, the leftmost of equals. Equal windows have equal seeds at equal
places, so occurrences of a window meet in the group of their seed. The consecutive windows that share one seed occurrence
are a reach: the tokens that a match through this seed can extend over, both ways. Equal reaches (same seed, same tokens,
by two 64-bit hashes of which one is the seed's) are settled at once, all their windows are repeats; different reaches of
one seed go on to be extended or sorted token by token.

A document is a doc_id and `own`: 0, or a digest of the text where several texts have the doc_id.

Reaches travel as arrays packed by bucket of the seed. Each task first settles equal reaches among its own rows and sends
one of each, so a seed that a third of all rows hold reaches the reducer once per task, not once per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ._arrow import group_starts, merge_spans, mix, ngrams, window_min, within

_PLACE = np.uint64((1 << 28) - 1)
_C = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Reaches:
    """Columns of equal length: seed, what (the hash of the reach), doc and own, lo (its first window) and span (windows after it)."""

    seed: np.ndarray
    what: np.ndarray
    doc: np.ndarray
    own: np.ndarray
    lo: np.ndarray
    span: np.ndarray
    done: np.ndarray  # already known to be a repeat

    def at(self, index: np.ndarray) -> Reaches:
        return Reaches(*(getattr(self, f)[index] for f in self.__dataclass_fields__))

    @staticmethod
    def concat(parts: list[Reaches]) -> Reaches:
        return Reaches(*(np.concatenate([getattr(p, f) for p in parts]) for f in Reaches.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.seed)


def none() -> Reaches:
    e = np.zeros(0, np.int64)
    return Reaches(e.astype(np.uint64), e.astype(np.uint64), e, e, e, e, e.astype(bool))


def find(tokens: np.ndarray, first: np.ndarray, docs: np.ndarray, own: np.ndarray, window: int, k: int, part: int = 1 << 21) -> Reaches:
    """The reaches of concatenated rows, made in parts of bounded size; a reach over the end of a part is two.

    tokens: a number for each token; first: each row's first token, and the end; docs, own: each row's document;
    window: tokens in a window; k: tokens in a seed.
    """
    total = int(first[-1])
    if total < window:
        return none()
    found = []
    inside = within(first, window)
    for begin in range(0, len(inside), part):
        at = begin + np.flatnonzero(inside[begin : begin + part])
        if not len(at):
            continue
        some = tokens[begin : begin + part + window - 1]
        grams, windows = ngrams(some, k), ngrams(some, window)
        least = window_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), window - k + 1)[: len(windows)]
        seed = (least[at - begin] & _PLACE).astype(np.int64)
        new = group_starts(seed)
        lo = at[new] - begin
        span = np.diff(np.append(np.flatnonzero(new), len(at))) - 1
        seed = seed[new]
        hi = lo + span
        what = mix(windows[lo] * _C + mix(windows[hi] + span.astype(np.uint64))) + (seed - lo).astype(np.uint64)
        r = np.searchsorted(first, lo + begin, "right") - 1
        found.append(Reaches(grams[seed], what, docs[r], own[r], lo + begin - first[r], span, np.zeros(len(lo), bool)))
    return Reaches.concat(found) if found else none()


def _pack(r: Reaches) -> bytes:
    base = int(r.doc.min())
    far = r.doc - base
    wide, several, long = int(far.max()) >= 1 << 32, bool(r.own.any()), int(r.span.max()) >= 1 << 8
    head = np.array([len(r), base, wide, several, long], "<i8").tobytes()
    own = r.own.astype("<i8").tobytes() if several else b""
    return b"".join([head, r.seed.astype("<u8").tobytes(), r.what.astype("<u8").tobytes(), far.astype("<u8" if wide else "<u4").tobytes(), own, r.lo.astype("<u4").tobytes(), r.span.astype("<u4" if long else "u1").tobytes(), np.packbits(r.done).tobytes()])


def _unpack(blob: memoryview) -> Reaches:
    n, base, wide, several, long = (int(x) for x in np.frombuffer(blob, "<i8", 5))
    at, out = 40, []
    for kind in ("<u8", "<u8", "<u8" if wide else "<u4", "<i8" if several else None, "<u4", "<u4" if long else "u1"):
        out.append(np.frombuffer(blob, kind, n, at) if kind else np.zeros(n, np.int64))
        at += out[-1].nbytes if kind else 0
    done = np.unpackbits(np.frombuffer(blob, "u1", -(-n // 8), at), count=n).astype(bool)
    return Reaches(out[0], out[1], out[2].astype(np.int64) + base, out[3], out[4].astype(np.int64), out[5].astype(np.int64), done)


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def joined(doc: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray) -> Spans:
    """The union of each document's spans."""
    order = np.lexsort((start, own, doc))
    doc, own, start, end = doc[order], own[order], start[order], end[order]
    new = group_starts(doc, own)
    number = np.cumsum(new) - 1
    wide = int(end.max(initial=0)) + 2
    if not len(doc) or int(number[-1]) * wide >= 1 << 62:
        return doc, own, start, end
    s, e = merge_spans(number * wide + start, number * wide + end)
    first = np.flatnonzero(new)[s // wide]
    return doc[first], own[first], s % wide, e % wide


#: Rows of the first shuffle: packed reaches by bucket of their seed, or packed spans with bucket -1 - (a number for the document).
PACKED = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
PACKED_DDL = "bucket long, blob binary"
#: What the reducer tells: spans of repeats (seed null), and reaches that remain (span of their windows' starts, both ends included).
TOLD = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int64()), ("kinds", pa.int32()), ("done", pa.bool_())])
TOLD_DDL = "doc_id long, own long, start int, end int, seed long, kinds int, done boolean"


class Sender:
    """Collects a task's reaches; settles equal ones among them; packs the rest by bucket."""

    def __init__(self, window: int, buckets: int, keep_first: bool, most: int = 500_000):
        self.window, self.buckets, self.keep_first, self.most = window, buckets, keep_first, most
        self.parts: list[Reaches] = []
        self.held = 0

    def add(self, r: Reaches) -> Iterator[pa.RecordBatch]:
        if len(r):
            self.parts.append(r)
            self.held += len(r)
            if self.held >= self.most:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        parts, self.parts, self.held = self.parts, [], 0
        r, new, size = _grouped(Reaches.concat(parts))
        del parts
        many = np.repeat(size > 1, size)
        settled = many & ~new if self.keep_first else many
        rows: list[tuple[int, bytes]] = []
        if settled.any():
            s = r.at(settled)
            spans = joined(s.doc, s.own, s.lo, s.lo + s.span + self.window)
            doc = spans[0]
            side = (mix(doc.astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(side, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(side[order])) + 1):
                rows.append((-1 - int(side[at[0]]), np.stack([x[at] for x in spans]).astype("<i8").tobytes()))
        r.done |= many & (not self.keep_first)
        r = r.at(new)
        side = (mix(r.seed ^ _C) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(side, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(side[order])) + 1):
            rows.append((int(side[at[0]]), _pack(r.at(at))))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=PACKED)


def _grouped(r: Reaches) -> tuple[Reaches, np.ndarray, np.ndarray]:
    """Sorted by seed, reach and place, without repeated places; which rows begin a group of equal reaches; each group's size."""
    r = r.at(np.lexsort((r.lo, r.own, r.doc, r.what, r.seed)))
    twice = ~group_starts(r.seed, r.what, r.doc, r.own, r.lo)  # one document in several rows
    if twice.any():
        keep = np.flatnonzero(~twice)
        done = np.logical_or.reduceat(r.done, keep)
        r = r.at(keep)
        r.done = done
    new = group_starts(r.seed, r.what)
    return r, new, np.diff(np.append(np.flatnonzero(new), len(r)))


def reduce(window: int, keep_first: bool):
    """Over all rows of some buckets: TOLD rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Reaches] = []
        for b in batches:
            for bucket, blob in zip(b["bucket"].to_pylist(), b["blob"], strict=True):
                if bucket >= 0:
                    parts.append(_unpack(blob.as_buffer()))
                else:
                    yield told(*np.frombuffer(blob.as_buffer(), "<i8").reshape(4, -1))
        if not parts:
            return
        r, new, size = _grouped(Reaches.concat(parts))
        first = np.flatnonzero(new)
        kinds = np.diff(np.append(np.flatnonzero(group_starts(r.seed[first])), len(first)))
        kinds = np.repeat(kinds, kinds)  # for each group, the different reaches of its seed
        many = (size > 1) | np.logical_or.reduceat(r.done, first)
        settled = np.repeat(many, size)
        settled &= ~new if keep_first else ~r.done
        if settled.any():
            s = r.at(settled)
            yield told(*joined(s.doc, s.own, s.lo, s.lo + s.span + window))
        rest = first[kinds > 1]
        if len(rest):
            s = r.at(rest)
            yield pa.RecordBatch.from_arrays([pa.array(s.doc), pa.array(s.own), pa.array(s.lo.astype(np.int32)), pa.array((s.lo + s.span).astype(np.int32)), pa.array(s.seed.view(np.int64)), pa.array(kinds[kinds > 1].astype(np.int32)), pa.array(many[kinds > 1])], schema=TOLD)

    return run


def told(doc: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(own), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())], schema=TOLD)
