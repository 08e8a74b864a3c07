"""MinHash near-dedup by a multi-index Hamming join.

A document's set of five-word shingles gives a signature of 50 b-bit numbers (b = 13). Two documents whose signatures
differ in at most 19 numbers differ, by the pigeonhole principle, in at most one number of at least one of the 10 chunks
of 5. So each chunk is indexed five times, each time without one of its numbers: the keys enumerate the allowed chunk
error, and all pairs within that distance share a key (at similarity 0.75 a pair shares none once in 20,000).

Links are confirmed on the full sets. Equal sets are one class from the start. In a bucket every class is first compared
with the least class; those whose signatures are not far apart make families of classes. Classes far from it are compared
in blocks with all classes of the bucket that are not close to it, and join the families of those they are not far from,
by a tree of links a block. So any two near duplicates that share a key are in one family. A family whose confirmed
links leave several components is then compared in blocks, the classes outside its largest component with all others, on
the full sets; each sends one link to each component it reaches. So no link between components is lost and no bucket or
family lists its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store
from ._arrow import LOWER, group_starts, hash_spans, mix, ngrams, ranges, slices, utf8, words
from .graph import components

SHINGLE = 5
SIMILARITY = (75, 100)
NUMBERS, CHUNK, BITS = 50, 5, 13
#: Classes whose signatures differ in more numbers (similarity well below 0.4) are no family.
FAR = 35
#: Of a class no further than this from a bucket's least class, all that differ from it in at most FAR - CLOSE numbers
#: (a pair of similarity 0.75 differs in more once in 10,000,000) are not far from the least class either.
CLOSE = 5
#: Classes of a block of a family or bucket.
BLOCK = 512

_SEEDS = mix(np.arange(1, 2 * NUMBERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted hashes of lower-cased words."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashed = hash_spans(data, starts, ends)
    five = ngrams(hashed, SHINGLE)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= SHINGLE:
            out.append(np.unique(five[a : z - SHINGLE + 1]))
        else:
            out.append(ngrams(hashed[a:z], int(z - a)) if z > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """NUMBERS numbers of BITS bits of each set; sets must not be empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), NUMBERS), "<u2")
    for k in range(NUMBERS):
        least = np.minimum.reduceat((flat ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1)), at)
        out[:, k] = mix(least) >> np.uint64(64 - BITS)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        sets = shingle_sets(*utf8(b["text"]))
        size = np.array([len(s) for s in sets], np.int64)
        h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        sig = [None] * len(sets)
        some = np.flatnonzero(size)
        if len(some):
            flat, at = np.concatenate([sets[i] for i in some]), np.concatenate([[0], np.cumsum(size[some])[:-1]])
            h1[some] = np.add.reduceat(mix(flat), at).view(np.int64)
            h2[some] = np.add.reduceat(mix(flat ^ _SEEDS[0]), at).view(np.int64)
            for i, s in zip(some, signatures([sets[i] for i in some]), strict=True):
                sig[i] = s.tobytes()
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size), pa.array(h1), pa.array(h2), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return utf8(column)[0].view("<u2").reshape(-1, NUMBERS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        sig, out = _matrix(b["sig"]).astype(np.uint64), []
        for chunk in range(NUMBERS // CHUNK):
            part = sig[:, chunk * CHUNK : (chunk + 1) * CHUNK]
            for error in range(CHUNK):
                key = np.full(len(sig), chunk * CHUNK + error + 1, np.uint64)
                for k in range(CHUNK):
                    if k != error:
                        key = key << np.uint64(BITS) | part[:, k]  # below 2**58: exact, no collisions
                out.append(key.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(b["rep"].to_numpy(), len(out)))], names=["key", "rep"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        sets = [s.astype("<u8").tobytes() for s in shingle_sets(*utf8(b["text"]))]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sets, pa.binary())], names=["id", "set"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b["set_a"], b["set_b"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            common = int((x[at] == y).sum())
            keep.append(SIMILARITY[1] * common >= SIMILARITY[0] * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            far = (_matrix(b["sig_a"]) != _matrix(b["sig_b"])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b["a"], b["b"], pa.array(far.astype(np.int32))], names=["a", "b", "far"])


def _tree(rep: np.ndarray, sig: np.ndarray, guest: np.ndarray) -> list[tuple[int, int]]:
    """Links that join each guest with all classes it is not far from, none that the others make needless."""
    own, (_, at) = np.flatnonzero(~guest), np.unique(rep, return_inverse=True)
    label, found = np.arange(len(at)), []
    for i in np.flatnonzero(guest):
        near = own[((sig[own] != sig[i]).sum(axis=1) <= FAR) & (rep[own] != rep[i])]
        labels, one = np.unique(label[at[near]], return_index=True)
        other = labels != label[at[i]]
        if other.any():
            found += [(min(rep[i], j), max(rep[i], j)) for j in rep[near[one[other]]]]
            label[np.isin(label, labels[other])] = label[at[i]]
    return found


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    key, g, o, rep, guest = (t[c].to_numpy() for c in ("key", "g", "o", "rep", "guest"))
    sig = _matrix(t["sig"])
    order = np.lexsort((rep, o, g, key))
    found: set[tuple[int, int]] = set()
    for at in np.split(order, np.flatnonzero(group_starts(key[order], g[order], o[order]))[1:]):
        found.update(_tree(rep[at], sig[at], guest[at]))
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _block(rep: np.ndarray, comp: np.ndarray, n: np.ndarray, sets: list[np.ndarray], guest: np.ndarray) -> list[tuple[int, int]]:
    """Links of each guest with one class of each other component."""
    own = np.flatnonzero(~guest)
    if not len(own):
        return []
    flat = np.concatenate([sets[i] for i in own])
    holder = np.repeat(np.arange(len(own)), n[own])
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], holder[order]
    found = []
    for i in np.flatnonzero(guest):
        first = np.searchsorted(flat, sets[i])
        common = np.bincount(holder[ranges(first, np.searchsorted(flat, sets[i], "right") - first)], minlength=len(own))
        ok = np.flatnonzero((SIMILARITY[1] * common >= SIMILARITY[0] * (n[own] + n[i] - common)) & (comp[own] != comp[i]))
        _, one = np.unique(comp[own[ok]], return_index=True)
        found += [(min(rep[i], j), max(rep[i], j)) for j in rep[own[ok[one]]]]
    return found


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    family, g, o, rep, comp, guest = (t[c].to_numpy() for c in ("family", "g", "o", "rep", "comp", "guest"))
    data, offsets = utf8(t["set"])
    flat, first = data.view("<u8"), offsets // 8
    n = np.diff(first)
    order = np.lexsort((o, g, family))
    found: list[tuple[int, int]] = []
    for at in np.split(order, np.flatnonzero(group_starts(family[order], g[order], o[order]))[1:]):
        found += _block(rep[at], comp[at], n[at], [flat[first[k] : first[k + 1]] for k in at], guest[at])
    pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _dealt(rows: DataFrame, of: str, guests: str, is_guest: Column) -> DataFrame:
    """rows for each pair of a block of guests (g) and a block of all rows (o) of a group; of and guests hold how many it has."""
    own_blocks, guest_blocks = (F.ceil(F.col(x) / BLOCK).cast("int") for x in (of, guests))
    own = rows.withColumn("guest", F.lit(False)).withColumn("o", F.pmod(F.xxhash64("rep"), own_blocks).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), guest_blocks - 1)))
    guest = rows.filter(is_guest).withColumn("guest", F.lit(True)).withColumn("g", F.pmod(F.xxhash64("rep"), guest_blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), own_blocks - 1)))
    return own.unionByName(guest)


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to join all that the candidates' links join.

    docs: doc_id, text. classes: rep (the doc_id whose text stands for the class), n, sig; a written table.
    """
    keys = _store.written(classes.mapInArrow(_keys, "key long, rep long"), "keys")
    shared = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count("*").alias("of"))
    shared = _store.written(shared.filter("pivot < last").drop("last"), "shared")
    members = _store.written(_store.lookup(keys, shared, ["key"], "of"), "members")
    stars = members.filter("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    sig = classes.select("rep", "sig")
    stars = stars.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a").select("a", "b", "sig_a", "sig_b")
    stars = _store.written(stars.mapInArrow(_apart, "a long, b long, far int"), "apart")
    ring = members.join(stars.filter(F.col("far") > CLOSE).toDF("pivot", "rep", "far"), ["pivot", "rep"]).select("key", "rep", (F.col("far") > FAR).alias("is_far"))
    ring = _store.written(ring, "ring")
    busy = ring.groupBy("key").agg(F.count("*").alias("of"), F.count_if("is_far").alias("guests"))
    busy = _store.written(busy.filter("guests > 0 and of > 1"), "busy")
    others = _store.written(_store.lookup(ring, busy, ["key"], "of").join(sig, "rep"), "others")
    rows = _dealt(others, "of", "guests", F.col("is_far")).select("key", "g", "o", "rep", "guest", "sig")
    joined = rows.repartition("key", "g", "o").mapInArrow(_joined, "a long, b long")
    stars = _store.written(stars.filter(F.col("far") <= FAR).select("a", "b").union(joined).distinct(), "stars")
    family = components(stars)  # of every class that has a star
    sets = _store.written(docs.join(family.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets, "id long, set binary"), "sets")
    pairs = stars.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    found = _store.written(pairs.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, "a long, b long"), "links")

    label = components(found)
    named = family.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = _store.written(named.select("rep", "family", F.coalesce("component", "rep").alias("comp")), "named")
    each = named.groupBy("family", "comp").agg(F.count("*").alias("here"))
    mixed = each.groupBy("family").agg(F.max_by("comp", F.struct("here", "comp")).alias("most"), F.count("*").alias("kinds"), F.sum("here").alias("of"), F.max("here").alias("in_most"))
    mixed = _store.written(mixed.filter("kinds > 1").select("family", "most", "of", "in_most"), "mixed")
    open_ = _store.written(_store.lookup(named, mixed, ["family"], "of"), "open")
    dealt = _dealt(open_.withColumn("guests", F.col("of") - F.col("in_most")), "of", "guests", F.col("comp") != F.col("most"))
    rows = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").select("family", "g", "o", "rep", "comp", "guest", "set")
    return found.union(_store.written(rows.repartition("family", "g", "o").mapInArrow(_across, "a long, b long"), "links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, n_shingles, component_id, kept, class_id.

    Words are runs of non-space characters, A-Z lower-cased; a text with fewer than five is one shingle; null, empty and
    blank texts have none, are linked with nothing and are kept. Texts with equal sets are one class (class_id is its
    least doc_id). component_id is the least doc_id reachable over links of Jaccard similarity 0.75 or more, kept whether
    it is the row's own. Rows that repeat a doc_id are one document, linked by any of their texts and kept or not together; a row
    without doc_id is linked with nothing and kept. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = _store.written(rows.mapInArrow(_signed, "doc_id long, n long, h1 long, h2 long, sig binary"), "signed")
    full = signed.filter("n > 0 and doc_id is not null")
    with _store.scope():
        classes = full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
        classes = _store.written(classes, "classes")
        label = components(links(rows, classes.select("rep", "n", "sig")))
        named = classes.select("h1", "h2", "n", "copies", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
        named = _store.result(named.select("h1", "h2", "n", "copies", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")), "named")
    some = _store.lookup(full.drop("sig"), named, ["h1", "h2", "n"], "copies").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    none = signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    every = some.unionByName(none)
    return every.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
