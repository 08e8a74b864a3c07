"""Language ID by prediction by partial matching.

Per language, a tree of byte contexts up to three bytes deep counts what follows each context. With the counts frozen,
the code length of a byte after a context is -log2 c/(t+d) if the language saw it there (c of t times, d different
followers), and otherwise the cost d/(t+d) of the escape plus the code length one context shorter; below the empty
context every byte costs eight bits. A text gets the language that codes all its bytes in the fewest bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumenlake import workers

from ._arrow import slices, utf8
from ._documents import with_plain_names

DEPTH = 3
UNKNOWN = "und"
#: Bounds of the training sample, for each language.
TRAIN_ROWS, TRAIN_BYTES = 1000, 2 << 20
#: Contexts of the full depth that were seen less often stay leaves of the context one shorter.
MIN_SEEN = 2
#: Contexts whose costs are worked out together.
STEP = 1024


@dataclass
class Model:
    """Frozen counts: codes are four bytes (three of context, zero before a text's start, and the one that followed)."""

    langs: list[str]
    codes: np.ndarray
    counts: np.ndarray  # codes x langs
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _fours(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The code of each byte of each row."""
    size = np.diff(offsets)
    place = np.arange(len(data)) + DEPTH * (np.repeat(np.arange(len(size)), size) + 1)
    padded = np.zeros(len(data) + DEPTH * (len(size) + 1), np.uint8)
    padded[place] = data
    lane = padded.astype(np.uint32)
    return (lane[place - 3] << 24) | (lane[place - 2] << 16) | (lane[place - 1] << 8) | lane[place]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        langs = np.array(batch["lang"].to_pylist(), object)
        for lang in sorted(set(langs)):
            codes, n = np.unique(_fours(*utf8(batch["text"].filter(pa.array(langs == lang)))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def train(labelled: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """A model of the rows (text, lang) of labelled that have both, from at most max_rows rows and max_bytes bytes a language.

    The sample is of distinct texts, ordered by a hash of the text, so it does not depend on ids, order, copies or
    partitions. Texts of more than max_bytes come last, and the text that passes max_bytes is cut there, so every language
    is in the model. Languages are few (codes such as ISO 639); what reaches the driver is their distinct byte 4-grams in
    the bounded sample. Repeated rows count once; without any labelled text, as in an empty table, the model is empty and
    every prediction is `und`; other columns are ignored.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null and text != ''")
    at = F.xxhash64("text")
    per_lang = rows.select("lang", at.alias("at")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    few = rows.join(F.broadcast(per_lang), "lang").filter((at.cast("double") / 2.0**64 + 0.5) * F.col("n") <= 2 * max_rows).select("text", "lang").distinct()
    size = F.octet_length("text")
    order = Window.partitionBy("lang").orderBy(size > max_bytes, at, "text")
    few = few.select("text", "lang", F.row_number().over(order).alias("nth"), (F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("before"))
    few = few.filter((F.col("nth") <= max_rows) & (F.col("before") < max_bytes))
    few = few.select(F.substring(F.col("text").cast("binary"), F.lit(1), (F.lit(max_bytes) - F.col("before")).cast("int")).alias("text"), "lang")
    found = few.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    codes, at = np.unique(found["code"].to_numpy().astype(np.uint32), return_inverse=True)
    counts = np.zeros((len(codes), len(langs)), np.int64)
    np.add.at(counts, (at, np.array([langs.index(x) for x in found["lang"].to_pylist()], np.int64)), found["n"].to_numpy())
    return Model(langs, codes, counts)


class Scorer:
    """A model's code lengths, laid out for lookups: symbols are the bytes it saw (0: any other), contexts have numbers."""

    def __init__(self, model: Model):
        seen = np.unique(np.stack([(model.codes >> s) & 255 for s in (0, 8, 16, 24)]))
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.langs, size = model.langs, len(seen) + 1
        a, b, c, s = (self.symbol[(model.codes >> k) & 255] for k in (24, 16, 8, 0))
        n = len(self.langs)
        cost = np.full((1, size, n), 8.0, np.float32)  # below the empty context
        number = np.zeros(1, np.int64)  # of the context with this code
        for depth in range(DEPTH + 1):
            code = {0: a * 0, 1: c, 2: b * size + c, 3: (a * size + b) * size + c}[depth]
            kept, at = np.unique(code, return_inverse=True)
            if depth == DEPTH:
                often = np.bincount(at, weights=model.counts.sum(axis=1), minlength=len(kept)) >= MIN_SEEN
                renamed = np.where(often, np.cumsum(often) - 1, -1)
                kept, at = kept[often], renamed[at]
            below_of = number[kept % size ** (depth - 1) if depth else kept * 0]
            here = np.empty((len(kept), size, n), np.float32)
            order = np.argsort(at, kind="stable")
            bounds = np.searchsorted(at[order], np.arange(0, len(kept) + STEP, STEP))
            for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):  # a few contexts at a time: the counts are wide
                rows, first = order[lo:hi], k * STEP
                tally = np.zeros((min(STEP, len(kept) - first), size, n), np.float32)
                np.add.at(tally, (at[rows] - first, s[rows]), model.counts[rows])
                total, kinds = tally.sum(axis=1, keepdims=True), (tally > 0).sum(axis=1, keepdims=True)
                below = cost[below_of[first : first + STEP]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    costs = np.where(tally > 0, -np.log2(tally / (total + kinds)), -np.log2(kinds / (total + kinds)) + below)
                here[first : first + STEP] = np.where(total > 0, costs, below)
            codes = np.arange(size**depth)
            inherited = number[codes % size ** (depth - 1)] if depth else np.zeros(1, np.int64)
            first = len(cost) if depth else 0
            cost = np.concatenate([cost, here]) if depth else here
            number = inherited.copy()
            number[kept] = first + np.arange(len(kept))
        self.cost, self.context, self.size = cost.reshape(len(cost) * size, n), number.astype(np.int32), size

    def bits(self, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """The code length of each row in each language."""
        size = np.diff(offsets)
        out = np.zeros((len(size), len(self.langs)))
        if not len(data):
            return out
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(data)) + DEPTH * (row + 1)
        padded = np.full(len(data) + DEPTH * (len(size) + 1), self.symbol[0], np.int64)
        padded[place] = self.symbol[data]
        for at in range(0, len(data), step):
            p = place[at : at + step]
            context = self.context[(padded[p - 3] * self.size + padded[p - 2]) * self.size + padded[p - 1]]
            cost = self.cost[context * np.int64(self.size) + padded[p]]
            first = np.flatnonzero(np.diff(row[at : at + step], prepend=-1))
            out[row[at : at + step][first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (any columns, text among them) with lang_pred and score added, in the place of columns of these names.

    lang_pred is a language of the model, the first in alphabetical order of those with the fewest bits, or `und` for a
    text that is null or has no letter; score is its posterior probability among the model's languages with equal
    priors, 0.0 for `und`. Only text is looked at, all of it; rows with equal texts get equal values; an empty table gives
    no rows.
    """
    return with_plain_names(docs.drop("lang_pred", "score"), ("text",), lambda plain: _predicted(plain, model))


def _predicted(docs: DataFrame, model: Model) -> DataFrame:
    keep = docs.columns
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = workers.kept("language model", model.key, lambda: Scorer(model)) if model.langs else None
        for batch in slices(batches, "text", 1 << 20):
            texts = batch["text"].to_pylist()
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            known = np.array([any(map(str.isalpha, t or "")) for t in texts], bool) & bool(model.langs)
            if scorer:
                bits = scorer.bits(*utf8(batch["text"]))
                best = bits.argmin(axis=1)
                score = np.where(known, 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True)).clip(0, 1000)).sum(axis=1), 0.0)
            names = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
