"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased. One pass joins documents to items
on their 3-grams: every 3-gram of an item is a seed, however often the corpus has it, and one seed makes a candidate.
Seeds of one item on neighbouring diagonals share a candidate. Its window of the document holds every alignment through
its seeds that can be a hit. Candidates with too few of the item's words for that are left out, which loses no hit, and
the others are aligned word by word in batches. Items are broadcast in blocks of bounded size, one pass each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store
from ._documents import with_plain_names
from ._arrow import LOWER, group_starts, hash_spans, ngrams, ranges, row_of, slices, utf8, within, words

SEED = 3
MATCH, MISMATCH, GAP = 2, 1, 1
#: Hits reach this part of the score of a whole copy, or the score of this many words in a row.
SCORE, LONG = 0.5, 25
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Seed hits of documents and items that are looked at together.
HITS = 1 << 20

_INSIDE = np.ones(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each row's first word (and the end)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, _INSIDE)
    return hash_spans(data, starts, ends), first


@dataclass
class Items:
    """A block of the benchmark."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Each 3-gram's hash and place; 3-grams lie in one item."""
        g = ngrams(self.words, SEED)
        at = np.flatnonzero(within(self.first, SEED))
        return g[at], at


class Known:
    """A sorted set of hashes, with a table of their high bits in front."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.sorted >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of hashes are known, and where in the sorted set."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)]) if len(self.sorted) else np.zeros(0, np.int64)
        where = np.searchsorted(self.sorted, hashes[at])
        where[where == len(self.sorted)] = 0
        ok = self.sorted[where] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[ok], where[ok]


def align(query: np.ndarray, q_size: np.ndarray, text: np.ndarray, t_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of padded rows: the best score, and where it ends (exclusive) in query and in text, the earliest of equals."""
    b, m, n = len(query), query.shape[1], text.shape[1]
    column = np.arange(n + 1)
    before = np.zeros((b, n + 1), np.int32)
    best, q_end, t_end = np.zeros(b, np.int32), np.zeros(b, np.int64), np.zeros(b, np.int64)
    inside = column[1:] <= t_size[:, None]
    for i in range(m):
        step = np.where((text == query[:, i : i + 1]) & inside, MATCH, -MISMATCH).astype(np.int32)
        here = np.maximum(before - GAP, 0)
        here[:, 1:] = np.maximum(here[:, 1:], before[:, :-1] + step)
        here = np.maximum.accumulate(here + GAP * column, axis=1) - GAP * column  # gaps along the text
        here = np.maximum(here, 0).astype(np.int32)
        here[q_size <= i] = 0
        at = here.argmax(axis=1)
        top = here[np.arange(b), at]
        more = top > best
        best[more], q_end[more], t_end[more] = top[more], i + 1, at[more]
        before = here
    return best, q_end, t_end


def _padded(source: np.ndarray, start: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    out = np.full((len(start), int(size.max(initial=0))), fill, np.uint64)
    out[np.repeat(np.arange(len(size)), size), ranges(np.zeros(len(size), np.int64), size)] = source[ranges(start, size)]
    return out


def _least(size: np.ndarray) -> np.ndarray:
    """The least score that makes a hit, for items of so many words."""
    return np.minimum(np.ceil(SCORE * MATCH * size), LONG * MATCH).astype(np.int64)


def _slack(size: np.ndarray) -> np.ndarray:
    """How many diagonals a hit can cover on either side of one of its seeds: each costs a gap."""
    return (MATCH * size - _least(size)) // GAP


def _candidates(doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(doc row, item, least and greatest diagonal) of hits sorted by doc, item and diagonal; hits of one item that are near in diagonal are together."""
    slack = _slack(size)
    begins = group_starts(doc, item)
    begins[1:] |= np.diff(diagonal) > slack[item[1:]]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(doc))
    out = []
    for k in np.flatnonzero(diagonal[ends - 1] - diagonal[starts] > 2 * size[item[starts]]):  # long runs are cut
        at, widest = int(starts[k]), 2 * int(size[item[starts[k]]])
        while (at := at + int(np.searchsorted(diagonal[at : ends[k]], diagonal[at] + widest, "right"))) < ends[k]:
            out.append(at)
    starts = np.sort(np.concatenate([starts, np.array(out, np.int64)]))
    ends = np.append(starts[1:], len(doc))
    return np.stack([doc[starts], item[starts], diagonal[starts], diagonal[ends - 1]], axis=1)


def _matched(items: Items, known: Known, order: np.ndarray, place: np.ndarray):
    size = np.diff(items.first)
    item_of = row_of(items.first)
    slack, least = _slack(size), _least(size)
    vocabulary, word_of = np.unique(items.words, return_inverse=True)
    listed = Known(vocabulary)
    item_words = np.unique(item_of * len(vocabulary) + word_of, return_counts=True)  # distinct words of each item, and how often it has them
    first_word = np.searchsorted(item_words[0], np.arange(len(items.ids) + 1) * len(vocabulary))
    posting = np.searchsorted(known.sorted, items.grams()[0])[order] * len(items.ids) + item_of[place[order]]  # sorted

    def hits(doc: np.ndarray, at: np.ndarray, where: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """The candidates of seeds where at words at of documents doc, for bounded numbers of hits at a time."""
        n = len(items.ids)
        many = np.searchsorted(posting, (where + 1) * n) - np.searchsorted(posting, where * n)
        total = np.cumsum(many)
        a = 0
        while a < len(at):
            z = int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right"))
            if z < len(at):
                z = int(np.searchsorted(doc, doc[z]))  # whole documents
            if z <= a:
                z = int(np.searchsorted(doc, doc[a], "right"))
            parts = min(n, -(-int(many[a:z].sum()) // HITS))
            for low, high in zip(*(np.linspace(0, n, parts + 1).astype(np.int64)[k : parts + k] for k in (0, 1)), strict=True):
                begin, end = (np.searchsorted(posting, where[a:z] * n + k) for k in (low, high))
                q = place[order[ranges(begin, end - begin)]]  # every place of the seed in the block
                if not len(q):
                    continue
                t = np.repeat(at[a:z], end - begin)
                d, item = np.repeat(doc[a:z], end - begin), item_of[q]
                diagonal = (t - first[d]) - (q - items.first[item])
                by = np.lexsort((diagonal, item, d))
                yield _candidates(d[by], item[by], diagonal[by], size)
            a = z

    def possible(item: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether so many of the item's words occur in the window that a hit is possible. place, word: where words of the block are."""
        keep = np.zeros(len(item), bool)
        for k in range(0, len(item), 4096):
            i = item[k : k + 4096]
            low = np.searchsorted(place, start[k : k + 4096])
            many = np.searchsorted(place, end[k : k + 4096]) - low
            present = np.unique(np.repeat(np.arange(len(i)), many) * len(vocabulary) + word[ranges(low, many)])
            own = first_word[i + 1] - first_word[i]
            at, row = ranges(first_word[i], own), np.repeat(np.arange(len(i)), own)
            wanted = row * len(vocabulary) + item_words[0][at] % len(vocabulary)
            found = present[np.minimum(np.searchsorted(present, wanted), len(present) - 1)] == wanted
            keep[k : k + 4096] = MATCH * np.bincount(row, item_words[1][at] * found, len(i)) >= least[i]
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w, first = tokens(b["text"])
            at, where = known.find(ngrams(w, SEED))
            ok = within(first, SEED)[at]
            at, where = at[ok], where[ok]
            if not len(at):
                continue
            words_at, word = listed.find(w)
            rows = []
            for found in hits(row_of(first)[at], at, where, first):
                found = found[np.argsort(size[found[:, 1]], kind="stable")]  # batches of like sizes
                d, i, low, high = found.T
                start = np.clip(low - slack[i], 0, None) + first[d]
                end = np.minimum(high + size[i] + slack[i] + first[d], first[d + 1])
                ok = possible(i, start, end, words_at, word)
                every = d[ok], i[ok], start[ok], end[ok]
                for k in range(0, len(every[0]), 256):
                    d, i, start, end = (x[k : k + 256] for x in every)
                    query, text = _padded(items.words, items.first[i], size[i], 0), _padded(w, start, end - start, 1)
                    best, q_end, t_end = align(query, size[i], text, end - start)
                    hit = np.flatnonzero(best >= least[i])
                    if not len(hit):
                        continue
                    d, i, start, best, q_end, t_end = d[hit], i[hit], start[hit], best[hit], q_end[hit], t_end[hit]
                    # the same alignment from its end finds where it begins
                    back_q, back_t = items.words[::-1], w[::-1]
                    _, _, t_len = align(_padded(back_q, len(items.words) - items.first[i] - q_end, q_end, 0), q_end, _padded(back_t, len(w) - start - t_end, t_end, 1), t_end)
                    rows.append(np.stack([d, i, best, start + t_end - t_len - first[d], start + t_end - first[d]]))
            if rows:
                d, i, best, start, end = np.concatenate(rows, axis=1)
                by = np.lexsort((end, start, -best, i, d))
                by = by[np.concatenate([[True], (np.diff(d[by]) != 0) | (np.diff(i[by]) != 0)])]
                d, i = d[by], i[by]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(d)), pa.array(items.ids[i]), pa.array(np.minimum(1.0, best[by] / (MATCH * size[i]))), pa.array(start[by]), pa.array(end[by])], names=["doc_id", "item_id", "score", "start", "end"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document of docs (doc_id long, text) and item of benchmark (item_id long, text) that it copies.

    Returns doc_id, item_id, score (the best alignment's share of a whole copy's score, at most 1) and start and end of that
    alignment in the document's words. Edited and partial copies count from half of a whole copy's score or 25 words in
    a row on. Items of fewer than three words, null and empty texts match nothing; empty tables give no rows; repeated
    rows of docs give repeated rows; equal items each match; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    out = None
    for k in range(blocks):
        block = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        w, first = tokens(block["text"]) if len(block) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        items = Items(block["item_id"].to_numpy(), w, first)
        gram, place = items.grams()
        if not len(gram):
            continue
        order = np.argsort(gram, kind="stable")
        found = rows.mapInArrow(_matched(items, Known(gram), order, place), "doc_id long, item_id long, score double, start long, end long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.filter("false").selectExpr("doc_id", "doc_id as item_id", "0D as score", "0L as start", "0L as end")
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that copy an item, with all their columns.

    A row without doc_id stays, also a copy; null and empty texts stay; of rows that repeat a doc_id all go if one copies an
    item; an empty table stays empty and an empty benchmark changes nothing.
    """
    found = _store.written(matches(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return with_plain_names(docs, ("doc_id", "text"), lambda plain: plain.join(found, "doc_id", "left_anti").select(*plain.columns))
