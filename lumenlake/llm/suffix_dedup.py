"""Suffix-array dedup over bytes.

Suffixes are dealt to shards by content, so that equal 100-byte strings meet: every 100-byte window goes with its winnowed
32-byte seed (see `_seeds`). Reaches with equal bytes are settled by hash; where the reaches of one seed differ, their bytes
go to the seed's shard, which sorts all its suffixes by induced sorting (`suffix`), computes the permuted common prefixes
and splits the order wherever fewer than 100 bytes are shared: each piece is the occurrences of one 100-byte string, and all
but the first are removed. A seed with very many different reaches would make one shard large without end; its windows
are dealt out singly by their own hash instead, which is exact too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _seeds, _store
from ._arrow import group_starts, mix, ngrams, ranges, slices, utf8
from ._documents import documents
from .repeats import buckets, spread
from .suffix import permuted_lcp, suffix_array

WINDOW, SEED = 100, 32
#: Seeds with more different reaches than this are settled window by window; a shard's text, but for one seed's.
MANY, SHARD = 1024, 1 << 20
#: Bytes of such reaches that are hashed at once.
HOT_BYTES = 1 << 18
#: Between the reaches of a shard; no byte of UTF-8.
END = 255
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _reaches(window: int, seed: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _seeds.Sender(window, n, keep_first=True)
        for b in slices(batches, "text", 1 << 19):
            data, offsets = utf8(b["text"])
            found = _seeds.find(data, offsets, b["doc_id"].to_numpy(), b["own"].to_numpy(), window, seed)
            yield from out.add(found)
        yield from out.flush()

    return run


def _pack(seed: np.ndarray, doc: np.ndarray, own: np.ndarray, lo: np.ndarray, size: np.ndarray, text: np.ndarray) -> bytes:
    return b"".join([np.array([len(seed)], "<i8").tobytes(), np.stack([seed, doc, own, lo, size]).astype("<i8").tobytes(), text.tobytes()])


def _open_reaches(window: int, n: int, most: int = 8 << 20):
    """The bytes of the remaining reaches for the shards (bucket n and on), or single windows by hash (buckets below n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = _seeds.Sender(window, n, keep_first=True)
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            seed, doc, own, lo, size = (np.concatenate([h[k] for h in held]) for k in range(5))
            text = np.concatenate([h[5] for h in held])
            held.clear()
            first = np.cumsum(size) - size
            side = (mix(seed.view(np.uint64)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(side, kind="stable")
            rows = [(n + int(side[at[0]]), _pack(seed[at], doc[at], own[at], lo[at], size[at], text[ranges(first[at], size[at])])) for at in np.split(order, np.flatnonzero(np.diff(side[order])) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=_seeds.PACKED)

        bytes_held = 0
        for b in slices(batches, "text", 1 << 20):
            data, offsets = utf8(b["text"])
            row, open_ = spread(b["open"])
            lo, hi, seed, kinds = (open_.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end", "seed", "kinds"))
            doc, own = b["doc_id"].to_numpy()[row], b["own"].to_numpy()[row]
            hot = kinds > MANY
            at_hot = np.flatnonzero(hot)
            pieces = np.cumsum((hi - lo)[at_hot] + window) // HOT_BYTES
            for some in np.split(at_hot, np.flatnonzero(np.diff(pieces)) + 1) if len(at_hot) else []:
                size = (hi - lo)[some] + 1
                text = data[ranges(lo[some] + offsets[row[some]], size + window - 1)]
                at = ranges(np.cumsum(size + window - 1) - (size + window - 1), size)  # where windows of the reaches begin in text
                which, start = np.repeat(some, size), ranges(lo[some], size)
                seeds, whats = ngrams(text, window)[at], ngrams(mix(text.astype(np.uint64) ^ _OTHER), window)[at]  # 128 bits together
                yield from single.add(_seeds.Reaches(seeds, whats, doc[which], own[which], start, np.zeros(len(at), np.int64), np.zeros(len(at), bool)))
            cold = ~hot
            size = (hi - lo)[cold] + window
            if len(size):
                held.append((seed[cold], doc[cold], own[cold], lo[cold], size, data[ranges(lo[cold] + offsets[row[cold]], size)]))
                bytes_held += int(size.sum())
                if bytes_held > most:
                    yield from sent()
                    bytes_held = 0
        if held:
            yield from sent()
        yield from single.flush()

    return run


def later_windows(doc: np.ndarray, own: np.ndarray, lo: np.ndarray, size: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of reaches (size bytes of a document from lo; text holds them one after the other): the windows whose bytes also start earlier."""
    ended = np.full(int(size.sum()) + len(size), END, np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    ended[np.arange(len(text)) + row] = text
    first = np.cumsum(size + 1) - (size + 1)
    owner = np.repeat(np.arange(len(size)), size + 1)
    inner = np.arange(len(ended)) - first[owner]
    sa = suffix_array(ended)
    shared = permuted_lcp(ended, sa)
    piece = np.cumsum(shared[sa] < window)
    starts = inner[sa] + window <= size[owner[sa]]  # a whole window begins here
    sa, piece = sa[starts], piece[starts]
    at = owner[sa]
    where = doc[at], own[at], lo[at] + inner[sa]
    order = np.lexsort((*where[::-1], piece))
    where = tuple(x[order] for x in where)
    new = group_starts(piece[order])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = np.logical_or.reduce([x != x[head] for x in where])
    return tuple(x[later] for x in where)


def _sorted_shards(window: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        single: list[pa.RecordBatch] = []
        for b in batches:
            bucket = b["bucket"].to_numpy()
            if (bucket < n).any():
                single.append(b.filter(pa.array(bucket < n)))
            for blob in b["blob"].filter(pa.array(bucket >= n)):
                raw = blob.as_buffer()
                m = int(np.frombuffer(raw, "<i8", 1)[0])
                parts.append((*np.frombuffer(raw, "<i8", 5 * m, 8).reshape(5, m), np.frombuffer(raw, np.uint8, offset=8 + 40 * m)))
        yield from _seeds.reduce(window, keep_first=True)(iter(single))
        if not parts:
            return
        seed, doc, own, lo, size, text = (np.concatenate([p[k] for p in parts]) for k in range(6))
        del parts
        first = np.cumsum(size) - size
        order = np.argsort(seed, kind="stable")
        groups = np.flatnonzero(group_starts(seed[order]))
        total = np.cumsum(size[order])
        cut, begin = [0], 0
        for g, z in zip(groups[1:], total[groups[1:] - 1], strict=True):  # whole seeds, about SHARD bytes together
            if z - begin >= SHARD:
                cut.append(int(g))
                begin = int(z)
        for a, z in zip(cut, [*cut[1:], len(order)], strict=True):
            at = order[a:z]
            d, o, p = later_windows(doc[at], own[at], lo[at], size[at], text[ranges(first[at], size[at])], window)
            yield _seeds.told(*_seeds.joined(d, o, p, p + window))

    return run


def _remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 2 << 20):
        data, offsets = utf8(b["text"])
        row, spans = spread(b["spans"].fill_null([]))
        start, end = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
        row, _, start, end = _seeds.joined(row, row, start, end)
        cut = np.searchsorted(row, np.arange(len(offsets)))
        raw, removed, digest = data.tobytes(), [], []
        for r, (a, z) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            kept, at, gone = hashlib.sha256(), int(a), 0
            for k in range(cut[r], cut[r + 1]):
                kept.update(raw[at : a + start[k]])
                at, gone = a + end[k], gone + end[k] - start[k]
            kept.update(raw[at:z])
            removed.append(int(gone))
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(np.diff(cut).astype(np.int64)), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def with_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, text and `spans` of docs (doc_id, text): array of (start, end) in bytes that are covered by windows which also start earlier; null: none.

    Earlier is a smaller doc_id, or an earlier start in the same document. The spans of a document may overlap and come in
    any order. Rows that repeat doc_id and text are one document, other rows with one doc_id are documents of their own,
    in the order of a digest of their texts; a row without doc_id has no spans.
    """
    rows = documents(docs)
    known = rows.filter("doc_id is not null")  # both joins below read one exchange of these
    n = buckets(docs)
    packed = known.mapInArrow(_reaches(window, seed, n), _seeds.PACKED_DDL)
    told = _store.written(packed.repartition("bucket").mapInArrow(_seeds.reduce(window, keep_first=True), _seeds.TOLD_DDL), "told")
    open_ = told.filter("seed is not null").groupBy("doc_id", "own").agg(F.collect_list(F.struct("start", "end", "seed", "kinds")).alias("open"))
    sent = known.join(open_, ["doc_id", "own"]).mapInArrow(_open_reaches(window, n), _seeds.PACKED_DDL)
    exact = sent.repartition("bucket").mapInArrow(_sorted_shards(window, n), _seeds.TOLD_DDL)
    spans = told.filter("seed is null").unionByName(exact).groupBy("doc_id", "own").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    nameless = rows.filter("doc_id is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return known.join(spans, ["doc_id", "own"], "left").unionByName(nameless).drop("own")


def remove_later(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of each row of docs (doc_id long, text).

    Each byte covered by a `window`-byte string that also starts earlier is removed; the rest is hashed. Null, empty and
    short texts lose nothing; a row without doc_id loses nothing and makes no others lose anything; rows that repeat
    doc_id and text are one document and lose the same, with other texts they are documents of their own; other columns
    are ignored; an empty table gives no rows.
    """
    return with_spans(docs, window, seed).mapInArrow(_remains, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
