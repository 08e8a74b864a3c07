"""Substring dedup over words: seed and extend.

Seeds are winnowed word 8-grams: every window of 35 words holds one. Documents are joined on their seeds (see `_seeds`).
Occurrences of a seed whose surroundings differ meet with the hashes of their words and are extended both ways, a word at
a time: after each step those stay together that still agree. Where the steps to the left and to the right together reach
35 words and another occurrence agrees in both, the words match; the union of an occurrence's matches over all its seeds
gives the maximal repeats of at least 35 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _seeds, _store
from ._arrow import group_starts, hash_spans, merge_spans, mix, ngrams, ranges, slices, utf8, words
from ._documents import documents

WINDOW, SEED = 35, 8


def buckets(df: DataFrame) -> int:
    """Two buckets for each shuffle partition that the session asks for, so rows between tasks stay few."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _reaches(window: int, seed: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _seeds.Sender(window, n, keep_first=False)
        for b in slices(batches, "text", 2 << 20):
            hashed, first = _hashes(b["text"])
            yield from out.add(_seeds.find(hashed, first, b["doc_id"].to_numpy(), b["own"].to_numpy(), window, seed))
        yield from out.flush()

    return run


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and each row's first word."""
    data, offsets = utf8(column)
    starts, ends, first = words(data, offsets)
    return hash_spans(data, starts, ends), first


def spread(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A list column's elements and the row of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten()


def _pack(seed: np.ndarray, doc: np.ndarray, own: np.ndarray, lo: np.ndarray, span: np.ndarray, place: np.ndarray, done: np.ndarray, tokens: np.ndarray) -> bytes:
    return b"".join([np.array([len(seed)], "<i8").tobytes(), np.stack([seed, doc, own, lo, span, place, done]).astype("<i8").tobytes(), tokens.astype("<u8").tobytes()])


def _anchors(window: int, k: int, n: int, most: int = 1 << 20):
    """Each remaining reach, with its words' hashes and its seed's place in it, for the bucket of its seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        words_held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            *fields, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = fields[4] + window
            first = np.cumsum(size) - size
            side = (mix(fields[0].view(np.uint64)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(side, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(side[order])) + 1)
            blobs = [_pack(*(f[at] for f in fields), tokens[ranges(first[at], size[at])]) for at in parts]
            yield pa.RecordBatch.from_arrays([pa.array([int(side[at[0]]) for at in parts], pa.int64()), pa.array(blobs, pa.binary())], schema=_seeds.PACKED)

        for b in slices(batches, "text", 2 << 20):
            hashed, first = _hashes(b["text"])
            grams = ngrams(hashed, k)
            row, open_ = spread(b["open"])
            lo, hi, seed, done = (open_.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "end", "seed", "done"))
            place = np.full(len(lo), -1, np.int64)
            for step in range(window - k, -1, -1):  # the first of the places that all windows of the reach have
                at = hi + step
                fits = np.flatnonzero(at <= lo + window - k)
                fits = fits[grams[at[fits] + first[row[fits]]] == seed[fits].view(np.uint64)]
                place[fits] = at[fits] - lo[fits]
            span = hi - lo
            held.append((seed, b["doc_id"].to_numpy()[row], b["own"].to_numpy()[row], lo, span, place, done, hashed[ranges(lo + first[row], span + window)]))
            words_held += int((span + window).sum())
            if words_held > most:
                yield from sent()
                words_held = 0
        if held:
            yield from sent()

    return run


def extend(seed: np.ndarray, span: np.ndarray, place: np.ndarray, tokens: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of reaches (tokens holds span + window of each, place is that of its seed): the rows and windows that another row matches.

    left[o] and right[o] are classes of the rows that agree in their seed and in o tokens before it, or in o from it on.
    """
    import pandas as pd

    size = span + window
    first = np.cumsum(size) - size
    named, _ = pd.factorize(tokens)
    kinds = int(named.max(initial=0)) + 1
    anchored, start = pd.factorize(seed)[0].astype(np.int64), first + place

    def steps(way: int, room: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Classes after 0, 1, ... tokens; -1 where the reach has ended."""
        now = anchored
        for step in range(most + 1):
            yield now
            live = np.flatnonzero((now >= 0) & (room > step))
            then = np.full(len(now), -1, np.int64)
            then[live] = pd.factorize(now[live] * kinds + named[start[live] + (step if way > 0 else -1 - step)])[0]
            now = then

    right = [x.astype(np.int32) for x in steps(1, size - place, window)]
    rows, windows = [], []
    for before, left in enumerate(steps(-1, place, window - k)):
        after = right[window - before]
        # the window begins `before` tokens ahead of the seed, and must be one of the reach
        ok = np.flatnonzero((left >= 0) & (after >= 0) & (place - before >= 0) & (place - before <= span))
        match, _ = pd.factorize(left[ok] * (int(after.max(initial=0)) + 1) + after[ok])
        many = ok[np.bincount(match, minlength=1)[match] > 1] if len(ok) else ok
        rows.append(many)
        windows.append(place[many] - before)
    return np.concatenate(rows), np.concatenate(windows)


def _extended(window: int, k: int, most: int = 100_000):
    """Spans of the windows that two anchored occurrences share, seeds about `most` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for blob in b["blob"]:
                raw = blob.as_buffer()
                m = int(np.frombuffer(raw, "<i8", 1)[0])
                parts.append((np.frombuffer(raw, "<i8", 7 * m, 8).reshape(7, m), np.frombuffer(raw, "<u8", offset=8 + 56 * m)))
        if not parts:
            return
        seed, doc, own, lo, span, place, done = np.concatenate([p[0] for p in parts], axis=1)
        tokens = np.concatenate([p[1] for p in parts])
        del parts
        first = np.cumsum(span + window) - (span + window)
        order = np.lexsort((lo, own, doc, seed))
        order = order[group_starts(seed[order], doc[order], own[order], lo[order])]  # one document in several rows
        begins = np.flatnonzero(group_starts(seed[order]))
        cuts = begins[np.flatnonzero(np.diff(begins // most, prepend=-1))]
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            at = order[a:z]
            rows, windows = extend(seed[at], span[at], place[at], tokens[ranges(first[at], span[at] + window)], window, k)
            new = done[at[rows]] == 0
            rows, start = at[rows[new]], (lo[at[rows]] + windows)[new]
            yield _seeds.told(*_seeds.joined(doc[rows], own[rows], start, start + window))

    return run


def _remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 2 << 20):
        data, offsets = utf8(b["text"])
        starts, ends, first = words(data, offsets)
        row, spans = spread(b["spans"].fill_null([]))
        start, end = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + first[row] for k in ("start", "end"))
        keep = np.ones(len(starts), bool)
        starts_at, ends_at = merge_spans(start, end)
        keep[ranges(starts_at, ends_at - starts_at)] = False
        raw, removed, digest = data.tobytes(), [], []
        for a, z in zip(first[:-1], first[1:], strict=True):
            own = np.flatnonzero(keep[a:z]) + a
            removed.append(int(z - a - len(own)))
            digest.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts[own], ends[own], strict=True)])).hexdigest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def with_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, text and `spans` of docs (doc_id, text): array of (start, end) in words, all windows of which also start anywhere else; null: none.

    The spans of a document may overlap and come in any order. Rows that repeat doc_id and text are one document, other
    rows with one doc_id are documents of their own. A row without doc_id has no spans.
    """
    rows = documents(docs)
    known = rows.filter("doc_id is not null")  # both joins below read one exchange of these
    n = buckets(docs)
    packed = known.mapInArrow(_reaches(window, seed, n), _seeds.PACKED_DDL)
    told = _store.written(packed.repartition("bucket").mapInArrow(_seeds.reduce(window, keep_first=False), _seeds.TOLD_DDL), "told")
    open_ = told.filter("seed is not null").groupBy("doc_id", "own").agg(F.collect_list(F.struct("start", "end", "seed", "done")).alias("open"))
    anchors = known.join(open_, ["doc_id", "own"]).mapInArrow(_anchors(window, seed, n), _seeds.PACKED_DDL)
    exact = anchors.repartition("bucket").mapInArrow(_extended(window, seed), _seeds.TOLD_DDL)
    spans = told.filter("seed is null").unionByName(exact).groupBy("doc_id", "own").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    nameless = rows.filter("doc_id is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return known.join(spans, ["doc_id", "own"], "left").unionByName(nameless).drop("own")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs (doc_id long, text).

    Each word covered by a window of `window` words that also starts anywhere else is removed, first occurrences too;
    kept words joined by one space are hashed. Null, empty and short texts lose nothing; a row without doc_id loses
    nothing and makes no others lose anything; rows that repeat doc_id and text are one document, with other texts they
    are documents of their own; other columns are ignored; an empty table gives no rows.
    """
    return with_spans(docs, window, seed).mapInArrow(_remains, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def maximal_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The maximal repeats themselves: doc_id, start and end in words, and their text with words joined by one space.

    Documents and the odd cases are as for `remove_repeats`; a document without repeats gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = utf8(b["text"])
            starts, ends, first = words(data, offsets)
            row, spans = spread(b["spans"])
            start, end = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
            row, _, start, end = _seeds.joined(row, row, start, end)
            raw = data.tobytes()
            text = [b" ".join([raw[s:e] for s, e in zip(starts[first[r] + a : first[r] + z], ends[first[r] + a : first[r] + z], strict=True)]).decode() for r, a, z in zip(row, start, end, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row)), pa.array(start), pa.array(end), pa.array(text, pa.string())], names=["doc_id", "start", "end", "text"])

    return with_spans(docs, window, seed).filter("spans is not null").mapInArrow(run, "doc_id long, start long, end long, text string")
