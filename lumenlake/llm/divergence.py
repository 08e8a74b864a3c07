"""Divergence of a language's sources by their terms.

Documents are counted on the map side to one row for each (language, source, term) of a task. A language's kept terms are
dealt to blocks by hash. A block is a dense matrix of groups by terms of 64-bit integers, worked on a tile of terms at a
time: all pairs of groups by broadcasting one group's row against the others', summed to a partial pair matrix, and a heap
of the largest terms for each group. Partial matrices are added up and heaps merged over the blocks.

All arithmetic is on integers and exact. No task holds more than a block: its number grows with the counted rows, and a
language of very many sources is dealt by pairs of source tiles too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._arrow import LOWER, row_of, slices, utf8, words

#: A term is kept in a language that has it in so many documents.
MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
#: Counted rows a block should have, numbers in a dense tile, sources in a tile of sources, and rows that a task counts before it sends them on.
BLOCK_ROWS, TILE, SOURCES, HELD = 50_000, 1 << 18, 256, 400_000

#: Terms are runs of anything but these bytes: letters A-Z and a-z and what is beyond ASCII are in terms.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEYS = ["lang", "source", "term"]


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as strings: their bytes without what is between."""
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    kept = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def _terms(batch: pa.RecordBatch) -> pa.Table:
    """Of each (lang, source, term) of a batch how often it is there and in how many rows."""
    data, offsets = utf8(batch["text"])
    starts, ends, first = words(LOWER[data], offsets, _SEPARATOR)
    term = _spans(LOWER[data], starts, ends).dictionary_encode()
    lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
    pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    _, names, group = np.unique(pair, return_index=True, return_inverse=True)  # a row of each group, and each row's group
    kinds, of_row = max(1, len(term.dictionary)), row_of(first)
    in_row, n = np.unique(of_row * kinds + term.indices.to_numpy(), return_counts=True)
    cell, at = np.unique(group[in_row // kinds] * kinds + in_row % kinds, return_inverse=True)
    size = np.bincount(at, weights=n, minlength=len(cell)).astype(np.int64)
    own = pa.array(names[cell // kinds])
    return pa.table([batch["lang"].take(own), batch["source"].take(own), term.dictionary.take(pa.array(cell % kinds)), pa.array(size), pa.array(np.bincount(at, minlength=len(cell)).astype(np.int64))], schema=_COUNTED)


def _added(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_COUNTED.names).cast(_COUNTED)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for b in slices(batches, "text"):
        held.append(_terms(b))
        if sum(t.num_rows for t in held) > HELD:
            held = [_added(held)]
            if held[0].num_rows > HELD // 2:  # mostly different ones: these are as few rows as they get here
                yield from held[0].to_batches(65536)
                held = []
    if held:
        yield from _added(held).to_batches(65536)


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (how often) and docs (in how many documents) of docs (text, lang, source)."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * n / total) for n up to total, without leaving 64 bits: three digits at a time."""
    out, rest = n // total, n % total
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _largest(values: np.ndarray, terms: list[bytes], top: int) -> list[int]:
    """The places of the `top` largest values, the least term first among equals."""
    at = np.arange(len(values))
    if len(at) > top:
        least = np.partition(values, len(at) - top)[len(at) - top]
        at = np.flatnonzero(values >= least)
    return heapq.nsmallest(top, at.tolist(), key=lambda i: (-int(values[i]), terms[i]))


_PARTIAL = "lang string, a int, b int, term string, value long"


def _block(top: int):
    """Of a block's rows and its language's groups: partial pair sums (a against b) and the largest terms of a (b null)."""

    def run(key: tuple, rows: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("number")
        number, total, kept, whole = (groups[c].to_numpy() for c in ("number", "total", "kept", "whole"))
        names = rows["term"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        names = names if isinstance(names, pa.DictionaryArray) else names.combine_chunks()
        term, n, every = names.indices.to_numpy(), rows["n"].to_numpy(), rows["every"].to_numpy()
        terms = [t.encode() for t in names.dictionary.to_pylist()]
        of = rows["number"].to_numpy()
        mine, held_here = np.searchsorted(number, of), of >= 0  # a row without a group only says that there is such a term
        tile_a, tile_b = key[2].as_py(), key[3].as_py()
        side_a, side_b = np.flatnonzero(number // SOURCES == tile_a), np.flatnonzero(number // SOURCES == tile_b)
        pairs = np.zeros((len(side_a), len(side_b)), np.int64)
        best: list[tuple[int, int, bytes]] = []
        step = max(1, TILE // max(1, len(number)))
        order = np.argsort(term, kind="stable")
        cut = np.searchsorted(term[order], np.arange(0, len(terms) + step, step))
        for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            at, width = order[lo:hi], min(step, len(terms) - k * step)
            dense = np.zeros((len(number), width), np.int64)
            own_rows = at[held_here[at]]
            dense[mine[own_rows], term[own_rows] - k * step] = n[own_rows]
            p = _share(dense + 1, (total + kept)[:, None])
            q = p[side_b]
            for i, g in enumerate(side_a):  # one group's row against all others' at once
                pairs[i] += _gain(p[g][None, :], q).sum(axis=1)
            if tile_a == tile_b:
                all_n = np.zeros(width, np.int64)
                all_n[term[at] - k * step] = every[at]
                own = _share(all_n + 1, int(whole[0] + kept[0]))
                for g in side_a:
                    there = np.flatnonzero((dense[g] > 0) & (p[g] > own))
                    values = _gain(p[g][there], own[there])
                    held = [terms[k * step + j] for j in there]
                    best += [(int(g), int(values[i]), held[i]) for i in _largest(values, held, top)]
        a, b = np.meshgrid(number[side_a], number[side_b], indexing="ij")
        apart = (a != b).ravel()
        found: dict[int, list[tuple[int, bytes]]] = {}
        for g, v, t in best:
            found.setdefault(g, []).append((-v, t))
        heaps = [(int(number[g]), t.decode(), -v) for g, x in found.items() for v, t in heapq.nsmallest(top, x)]
        size = int(apart.sum()) + len(heaps)
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * size, pa.string()),
                "a": pa.array(np.concatenate([a.ravel()[apart], np.array([h[0] for h in heaps], np.int64)]).astype(np.int32)),
                "b": pa.concat_arrays([pa.array(b.ravel()[apart].astype(np.int32)), pa.nulls(len(heaps), pa.int32())]),
                "term": pa.concat_arrays([pa.nulls(int(apart.sum()), pa.string()), pa.array([h[1] for h in heaps], pa.string())]),
                "value": pa.array(np.concatenate([pairs.ravel()[apart], np.array([h[2] for h in heaps], np.int64)])),
            }
        )

    return run


def _ranked(rows: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def _groups(docs: DataFrame, keep: DataFrame, own: DataFrame, parts: int) -> DataFrame:
    """Each (lang, source) with its number in its language, total (N), kept (V), whole (the language's N), and into how many blocks and tiles its language is dealt."""
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    of_group = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    of_lang = keep.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("every").alias("whole"))
    groups = every.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "kept", "whole", "rows"])
    lang = Window.partitionBy("lang")
    groups = groups.withColumns({"number": F.row_number().over(lang.orderBy("source")) - 1, "sources": F.count("*").over(lang), "rows": F.sum("rows").over(lang)})
    by_rows, by_cells = F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("kept") * F.col("sources") / (64 * TILE))
    blocks = F.greatest(by_rows, by_cells, F.least("kept", F.lit(max(1, parts // 8))), F.lit(1)).cast("int")
    return groups.select("lang", "source", "number", "total", "kept", "whole", blocks.alias("blocks"), F.ceil(F.col("sources") / SOURCES).cast("int").alias("tiles"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how each source of a language differs from the others, and by which terms.

    docs: text, lang, source, null being ''. A term is a run of letters and characters beyond ASCII, A-Z in lower case; a
    language keeps those in at least min_docs of its documents, V of them. A group (lang, source) and a language have
    p = 1 + floor(UNIT * (n + 1) / (N + V)) of each kept term, n being how often it is there and N the sum of n. Part `pair`
    has for each other source of the language the sum of floor((p - q)^2 / q) over all kept terms, q being the other's (0
    without kept terms). Part `term` has the `top` terms of the group with p above the language's q, by the same value.
    Ranks are from 1 by value, largest first, equal values by item. Repeated rows count each; empty texts make a group
    without terms; very long texts are counted whole, very long terms as any; an empty table gives no rows; other columns
    are ignored.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = _store.written(counts(docs), "counts")
    keep = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("every")).filter(F.col("docs") >= min_docs).select("lang", "term", "every")
    keep = _store.written(keep, "kept")
    own = _store.written(counted.join(keep, ["lang", "term"]).select("lang", "source", "term", "n", "every"), "own")
    groups = _store.written(_groups(docs, keep, own, parts), "groups")
    key, number = ["lang", "block", "tile_a", "tile_b"], F.floor(F.col("number") / SOURCES)
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    in_tiles = lambda rows: rows.withColumn("tile_a", F.explode(tiles)).withColumn("tile_b", F.explode(tiles))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    wanted = (number == F.col("tile_a")) | (number == F.col("tile_b"))
    dealt = in_tiles(own.join(groups.select("lang", "source", "number", "blocks", "tiles"), ["lang", "source"])).filter(wanted)
    # With one tile of sources every kept term has a row in it; with more, a pair of tiles is told of the others.
    wide = groups.filter("number = 0 and tiles > 1").select("lang", "blocks", "tiles")
    rest = in_tiles(keep.join(wide, "lang")).withColumns({"number": F.lit(-1), "n": F.lit(0).cast("long")})
    dealt, rest = (x.withColumn("block", block).select(*key, "number", "term", "n", "every") for x in (dealt, rest))
    dealt = dealt.unionByName(rest)
    places = in_tiles(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).filter(wanted)
    places = places.select(*(F.col(c).alias(c) for c in (*key, "number", "total", "kept", "whole")))  # columns of their own, for the cogroup
    found = _store.written(dealt.groupBy(*key).cogroup(places.groupBy(*key)).applyInArrow(_block(top), _PARTIAL), "partial")
    a = groups.select("lang", F.col("number").alias("a"), "source")
    b = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    pairs = found.filter("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = found.filter("b is null").join(a, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", _ranked(terms)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", _ranked(pairs)).unionByName(terms)
