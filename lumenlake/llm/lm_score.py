"""Language-model scores by stupid backoff, computed relationally.

Documents are dealt to chunks of a few megabytes. Each chunk explodes its words into n-grams and keeps one entry of each
with its count: the exploded table, packed by hash bucket of the n-gram. A bucket adds the entries up to the count table
of its n-grams and joins them back to each chunk's entries, in their order; the chunk joins the counts to its documents'
n-grams and sums per document. An n-gram is at most one entry a chunk, however frequent it is.

Counts are those of all other documents: a document's own occurrences are taken off, so that rare text does not vouch for
itself. Words and word pairs are counted first. An n-gram of three words or more can only occur in another document if the
n-grams one shorter at its begin and end do, so each further length is exploded where both are known to: what is left
out has count 0 for certain. The order is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._arrow import hash_spans, mix, ngrams, row_of, utf8, within, words
from .repeats import buckets

BACKOFF = 0.4
ORDER = 3
CHUNK_BYTES = 8 << 20
_UNI = np.uint64(0xA0761D6478BD642F)
#: Its count is the number of words.
_TOTAL = np.uint64(0)


class _Entries:
    """A chunk's n-grams of some lengths in the order of bucket and hash, and for each occurrence which of them it is."""

    def __init__(self, every: np.ndarray, n: int):
        grams, which, count = np.unique(every, return_inverse=True, return_counts=True)
        side = (grams % np.uint64(n)).astype(np.int64)
        by = np.argsort(side, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.grams, self.count, self.side, self.which = grams[by], count[by], side[by], place[which]
        self.cut = np.append(np.flatnonzero(np.diff(self.side, prepend=-1)), len(self.side))

    def packed(self) -> tuple[np.ndarray, list[bytes]]:
        """The buckets, and the entries of each."""
        parts = zip(self.cut[:-1], self.cut[1:], strict=True)
        return self.side[self.cut[:-1]], [np.array([z - a], "<i8").tobytes() + self.grams[a:z].astype("<u8").tobytes() + _small(self.count[a:z]) for a, z in parts]

    def joined(self, found: pa.Table) -> np.ndarray:
        """The corpus count of each occurrence; found: bucket, blob."""
        every = np.zeros(len(self.grams), np.int64)
        begin = dict(zip(self.side[self.cut[:-1]].tolist(), self.cut[:-1].tolist(), strict=True))
        for bucket, blob in zip(found["bucket"].to_pylist(), found["blob"], strict=True):
            part = _large(blob.as_buffer())
            every[begin[bucket] : begin[bucket] + len(part)] = part
        return every[self.which]


class _Chunk:
    """A chunk's words, and level by level what other documents hold of its n-grams: level 1 is words and pairs, level k is n-grams of k + 1 words."""

    def __init__(self, text: pa.ChunkedArray, n: int, order: int):
        data, offsets = utf8(text)
        starts, ends, self.first = words(data, offsets)
        self.hashed = hash_spans(data, starts, ends)
        self.row, self.n, self.order = row_of(self.first), n, order
        #: For each length from 1, and each place where such an n-gram may begin: how often it is in other documents.
        self.others: list[np.ndarray] = []
        self.total = 0

    def entries(self) -> _Entries:
        """What the next level has to count."""
        words_ = len(self.hashed)
        if not self.others:
            self.at = [np.arange(words_)]
            every = [mix(self.hashed ^ _UNI)]
            if self.order > 1:
                self.at.append(np.flatnonzero(within(self.first, 2)))
                every.append(ngrams(self.hashed, 2)[self.at[1]])
            out = _Entries(np.concatenate([*every, [_TOTAL]]), self.n)
            out.count[out.which[-1]] += words_ - 1
            return out
        k = len(self.others) + 1
        held = self.others[-1] > 0
        at = np.flatnonzero(within(self.first, k))
        self.at = [at[held[at] & held[at + 1]]]
        return _Entries(ngrams(self.hashed, k)[self.at[0]] if len(self.at[0]) else np.zeros(0, np.uint64), self.n)

    def join(self, entries: _Entries, found: pa.Table) -> None:
        counts = entries.joined(found)
        if not self.others:
            self.total = int(counts[-1])
        begin = 0
        for at in self.at:
            held = np.zeros(len(self.hashed), np.int64)
            which = entries.which[begin : begin + len(at)]
            held[at] = counts[begin : begin + len(at)] - _own(self.row[at], which, len(entries.grams))
            self.others.append(held)
            begin += len(at)


def _small(values: np.ndarray) -> bytes:
    """Mostly small positive numbers: a byte each, and the large ones after them."""
    large = np.flatnonzero(values > 255)
    return b"".join([np.array([len(values), len(large)], "<i8").tobytes(), np.where(values > 255, 0, values).astype("u1").tobytes(), large.astype("<i8").tobytes(), values[large].astype("<i8").tobytes()])


def _large(raw: memoryview, at: int = 0) -> np.ndarray:
    n, m = (int(x) for x in np.frombuffer(raw, "<i8", 2, at))
    out = np.frombuffer(raw, "u1", n, at + 16).astype(np.int64)
    out[np.frombuffer(raw, "<i8", m, at + 16 + n)] = np.frombuffer(raw, "<i8", m, at + 16 + n + 8 * m)
    return out


def _own(row: np.ndarray, which: np.ndarray, kinds: int) -> np.ndarray:
    """How often the n-gram of each occurrence is in its own row."""
    _, at, n = np.unique(row * kinds + which, return_inverse=True, return_counts=True)
    return n[at]


def _known(docs: pa.Table, counts: pa.Table, levels: int, n: int, order: int) -> _Chunk:
    """A chunk with the counts of so many levels."""
    c = _Chunk(docs["text"], n, order)
    level = counts["level"].to_numpy() if counts.num_rows else np.zeros(0, np.int64)
    for k in range(1, levels + 1):
        c.join(c.entries(), counts.filter(pa.array(level == k)))
    return c


def _exploded(level: int, n: int, order: int):
    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        side, blobs = _known(docs, counts, level - 1, n, order).entries().packed() if docs.num_rows else (np.zeros(0, np.int64), [])
        return pa.table({"bucket": pa.array(side), "chunk": pa.array([key[0].as_py()] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[np.ndarray], list[np.ndarray]]]:
    """Each bucket's chunks with their n-grams and counts; only one bucket at a time is unpacked."""
    held: dict[int, list[tuple[int, memoryview]]] = {}
    for b in batches:
        for bucket, chunk, blob in zip(b["bucket"].to_pylist(), b["chunk"].to_pylist(), b["blob"], strict=True):
            held.setdefault(bucket, []).append((chunk, blob.as_buffer()))
    for bucket in sorted(held):
        rows = held.pop(bucket)
        sizes = [int(np.frombuffer(raw, "<i8", 1)[0]) for _, raw in rows]
        yield bucket, [c for c, _ in rows], [np.frombuffer(raw, "<u8", n, 8) for (_, raw), n in zip(rows, sizes, strict=True)], [_large(raw, 8 + 8 * n) for (_, raw), n in zip(rows, sizes, strict=True)]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over all chunks, sent back to each in the order of its entries."""
    for bucket, chunks, grams, counts in _by_bucket(batches):
        _, which = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)[which]
        parts = np.split(total, np.cumsum([len(g) for g in grams])[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int64()), pa.array([_small(x) for x in parts], pa.binary())], names=["chunk", "bucket", "blob"])


def _summed(levels: int, n: int, order: int):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        c = _known(docs, counts, levels, n, order)
        size = np.diff(c.first)
        score = np.where(c.others[0] > 0, c.others[0], BACKOFF) / np.maximum(c.total - size[c.row], 1)
        for k, (shorter, longer) in enumerate(zip(c.others[: order - 1], c.others[1:order], strict=True), 1):
            at = np.flatnonzero(within(c.first, k + 1))
            seen = longer[at] > 0
            score[at + k] = np.where(seen, longer[at] / np.where(seen, shorter[at], 1), BACKOFF * score[at + k])
        total_log = np.bincount(c.row, weights=np.log10(score), minlength=len(size))
        mean = np.round(total_log / np.maximum(size, 1), 6)
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(size), "score": pa.array(mean, mask=size == 0)})

    return run


def _dealt(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, text and chunk, and the number of buckets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = buckets(docs)
    chunks = max(-(-size // chunk_bytes), n // 2)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long"))), n


def scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, order: int = ORDER) -> DataFrame:
    """doc_id, n_words and score (mean log10 per word, 6 places) of each row of docs (doc_id long, text).

    Words are runs of non-space characters. A word after others scores c(all)/c(all before) over the longest context of at
    most order - 1 words, if the other documents hold the n-gram, else 0.4 of its score in a context one shorter; without
    context it scores c(word)/N. A word that no other document holds counts 0.4; N is the
    other documents' number of words, at least 1. Texts without words have a null score; repeated rows are
    documents of their own; other columns are ignored; an empty table gives no rows.
    """
    dealt, n = _dealt(docs, chunk_bytes)
    levels = max(1, order - 1)
    known = None
    for level in range(1, levels + 1):
        before = known if known is not None else docs.sparkSession.createDataFrame([], "chunk long, bucket long, blob binary, level int")
        exploded = dealt.groupBy("chunk").cogroup(before.groupBy("chunk")).applyInArrow(_exploded(level, n, order), "bucket long, chunk long, blob binary")
        counted = exploded.repartition("bucket").mapInArrow(_added, "chunk long, bucket long, blob binary").withColumn("level", F.lit(level))
        counted = _store.written(counted, "counts")
        _store.free_shuffles(docs.sparkSession)
        known = counted if known is None else known.unionByName(counted)
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_summed(levels, n, order), "doc_id long, n_words long, score double")


def count_table(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """gram (hash of a word or word pair) and n (how often all documents have it), partitioned by hash: the model's first table.

    One further row holds the number of words, under gram 0. Nulls, empty texts and an empty table add nothing.
    """
    dealt, n = _dealt(docs, chunk_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, grams, counts in _by_bucket(batches):
            gram, which = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(total)], names=["gram", "n"])

    none = docs.sparkSession.createDataFrame([], "chunk long, level int")
    exploded = dealt.groupBy("chunk").cogroup(none.groupBy("chunk")).applyInArrow(_exploded(1, n, 2), "bucket long, chunk long, blob binary")
    return exploded.repartition("bucket").mapInArrow(run, "gram long, n long")
