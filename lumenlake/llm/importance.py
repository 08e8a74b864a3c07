"""Importance resampling towards a target distribution, by hashed n-grams.

Each task runs DuckDB over its texts, a bounded batch at a time: SQL splits and unnests words, a window puts runs of one to
three words together, a registered function gives their CRC-32, and each text's buckets are counted. These bucket counts are
written to Parquet. Spark adds them up by bucket for the corpus and for the target, works out each bucket's gain, and
scores every document from its stored counts. Scores are ranked in ranges of their order, so no task ranks all documents.
"""

from __future__ import annotations

import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators import ordering

from . import _store
from ._arrow import slices

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Text of a batch, and what DuckDB may hold before it spills to the task's own temporary folder.
BATCH_BYTES, MEMORY = 1 << 20, "256MB"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Buckets of each text of `texts` (row, text) with their counts, and its number of words. Only A-Z are lowered; words are
#: runs of digits, a-z and what is beyond ASCII.
_COUNTED = rf"""
WITH split AS (SELECT row, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
word AS (SELECT row, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM split),
run AS (SELECT row, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM word WINDOW w AS (PARTITION BY row ORDER BY i)),
feature AS (SELECT row, unnest([a, a || ' ' || b, a || ' ' || b || ' ' || c]) AS f FROM run),
bucket AS (SELECT row, (zlib_crc32(f) % {BUCKETS})::SMALLINT AS bucket, count(*) AS n FROM feature WHERE f IS NOT NULL GROUP BY ALL),
held AS (SELECT row, list(bucket) AS buckets, list(n) AS counts FROM bucket GROUP BY row)
SELECT split.row, len(words)::BIGINT AS n_words, buckets, counts FROM split LEFT JOIN held USING (row) ORDER BY split.row
"""


def _crc32(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw, crc = data.to_pybytes() if data is not None else b"", zlib.crc32
    return pa.array([crc(raw[a:z]) for a, z in zip(at, at[1:], strict=False)], pa.int64())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    spill = tempfile.mkdtemp()  # DuckDB's own, gone with the task
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill})
    try:
        con.create_function("zlib_crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
        for b in slices(batches, "text", BATCH_BYTES):
            con.register("texts", pa.table({"row": pa.array(range(b.num_rows), pa.int64()), "text": b["text"]}))
            found = con.sql(_COUNTED).to_arrow_table().combine_chunks()
            con.unregister("texts")
            counted = [found[c].combine_chunks().cast(t) for c, t in (("n_words", pa.int64()), ("buckets", pa.list_(pa.int16())), ("counts", pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *counted], names=["doc_id", "n_words", "buckets", "counts"])
    finally:
        con.close()
        shutil.rmtree(spill, ignore_errors=True)


def features(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, and buckets with their counts (null without words) of rows (doc_id, text not null)."""
    return rows.mapInArrow(_features, "doc_id long, n_words long, buckets array<short>, counts array<long>")


def _totals(found: DataFrame, name: str) -> DataFrame:
    """How many features of all texts each bucket has: at most BUCKETS rows a task are shuffled."""
    each = found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").cast("int").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket, in doubles: BUCKETS numbers for the driver."""
    every = source.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(_totals(source, "s"), "bucket", "left").join(_totals(target, "t"), "bucket", "left").na.fill(0)
    held = np.zeros((BUCKETS, 2), np.float64)
    for r in both.collect():
        held[r["bucket"]] = r["s"], r["t"]
    s, t = held.T
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight from stored bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["buckets"]
            size = np.diff(lists.offsets.to_numpy())
            n = b["counts"].flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for v in (n, gain[lists.flatten().to_numpy(zero_copy_only=False)] * n)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_words"], *(pa.array(v.astype(np.int64)) for v in sums)], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))): h from the first 32 bits of a digest of seed and doc_id."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id long, text), drawn towards target (text).

    Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII; features are runs of one to three
    words, each counted in the bucket of its CRC-32. weight is the sum of the gains of a text's features; score adds Gumbel
    noise by doc_id, so the largest scores are a draw without replacement. Of the N documents with at least min_words words
    floor(percent * N / 100) are drawn and ranked from 1, equal scores by doc_id; rank is null for the others. Null and
    empty texts have no features and weight 0; very long texts are counted whole; repeated rows are documents each, and
    rank one after the other; an empty target leaves only smoothing; empty docs give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    source = _store.written(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)), "buckets")
    wanted = _store.written(features(target.select(F.lit(0).cast("long").alias("doc_id"), text)), "target")
    scored = _weights(source, gains(source, wanted)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = _store.written(scored, "scores")
    drawn = (scored.filter(F.col("n_words") >= min_words).count() * percent) // 100
    late = F.col("n_words") < min_words
    ranged = _store.written(ordering.in_ranges(scored, [late, F.desc("score"), F.col("doc_id"), F.col("n_features"), F.col("weight")]), "ranked")
    place = ordering.placed(ranged)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return place.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
