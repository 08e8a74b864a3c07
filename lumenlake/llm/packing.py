"""Best-fit packing by exact-complement hashing.

Documents become token ids; longer ones are cut into pieces; pieces fill sequences of a fixed capacity.
Only the histogram of piece lengths (at most `capacity` numbers, whatever the corpus) is planned on the driver:
indexes of single, pair and triple length sums find combinations that fill a gap exactly, consumed under the
counts that are left; what has no exact complement is packed best-fit, longest first. Every piece then finds its
place from its number among the pieces of its length, with a binary search in the plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _store
from ._arrow import slices

CAPACITY = 2048
#: Kept token ids of word forms, per Python worker.
MEMO = 1_000_000

# Where tokens can be cut for certain: ASCII white space, and Latin letters followed by an ASCII character that is no letter.
_CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\t-\r -@\[-`{-~]|\Z)| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Other white space and special tokens: such a text goes to the tokenizer as a whole.
_WHOLE = re.compile("[\x85\xa0  -     　]|<\\|endoftext\\|>")


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable ones are themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder(dict):
    """A text's ids by a byte-level tokenizer as little-endian 32-bit numbers, remembering the parts between certain cuts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        if _LETTERS.fullmatch(part):  # one pre-token
            ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        found = self[part] = np.array(ids, "<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        if _WHOLE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, seen = Encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encoder.encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                start, length = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    for k, v in zip(rows, (doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length])), strict=True):
                        rows[k].append(v)
                    seen[length] += 1
                    start, length = start + length, capacity
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]))

    return run


Pattern = tuple[list[tuple[int, int]], int]


def _exact(left: np.ndarray, capacity: int, most: int) -> list[Pattern]:
    """Sequences that at most `most` pieces beside their longest fill exactly, largest first; takes their pieces off left."""
    out: list[Pattern] = []
    here = (left[:capacity] > 0).astype(np.int64)  # index of single lengths
    pairs = np.rint(np.convolve(here, here)).astype(np.int64)[: 2 * capacity]  # index of pair sums: how many ordered pairs

    def drop(length: int) -> None:
        """From both indexes."""
        here[length] = 0
        at = np.flatnonzero(here)
        pairs[at + length] -= 2
        pairs[2 * length] -= 1

    def take(lengths: list[int]) -> None:
        used = np.unique(lengths, return_counts=True)
        n = int(min(left[used[0]] // used[1]))
        out.append(([(int(a), int(b)) for a, b in zip(*used, strict=True)], n))
        for a, b in zip(*used, strict=True):
            left[a] -= n * b
            if left[a] == 0 and a < capacity:
                drop(a)

    def enough(lengths: list[int]) -> bool:
        used = np.unique(lengths, return_counts=True)
        return bool((left[used[0]] >= used[1]).all())

    def two(first: list[int], gap: int, top: int) -> list[int] | None:
        """The pair that fills the gap under the counts that are left, with the longest length up to top."""
        if gap < 2 or pairs[gap] <= 0:
            return None
        a = np.arange(min(gap - 1, top), (gap - 1) // 2, -1)
        for x in a[(here[a] > 0) & (here[gap - a] > 0)]:
            if enough([*first, int(x), gap - int(x)]):
                return [*first, int(x), gap - int(x)]
        return None

    def fill(length: int, beside: int) -> list[int] | None:
        """The pieces of a full sequence of `length` and `beside` others, none longer."""
        gap = capacity - length
        if beside == 0:
            return [length] if gap == 0 else None
        if beside == 1:
            return [length, gap] if 0 < gap <= length and here[gap] and enough([length, gap]) else None
        if beside == 2:
            return two([length], gap, length)
        a = np.arange(min(gap - 2, length), (gap - 1) // 3, -1)  # triples: a single and a pair
        for x in a[(here[a] > 0) & (pairs[gap - a] > 0)]:
            if enough([length, int(x)]) and (found := two([length, int(x)], gap - int(x), int(x))):
                return found
        return None

    for beside in range(most + 1):
        for length in np.flatnonzero(left)[::-1].tolist():
            while left[length] > 0 and (found := fill(length, beside)):
                take(found)
    return out


def _best_fit(rest: np.ndarray, capacity: int) -> list[Pattern]:
    """Sequences of the pieces of rest, longest first, each in the fullest sequence that has room."""
    # room: patterns by the room they leave, each with how many sequences follow it.
    room: dict[int, list[Pattern]] = {}
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        while n:
            fits = [r for r in room if r >= length]
            if fits:
                r = min(fits)
                pattern, copies = room[r].pop()
                if not room[r]:
                    del room[r]
            else:
                r, pattern = capacity, []
                copies = -(-n // (capacity // length))
            each = min(r // length, -(-n // copies))
            full = min(copies, n // each)
            if copies > full and pattern:
                room.setdefault(r, []).append((pattern, copies - full))
            room.setdefault(r - each * length, []).append(([*pattern, (length, each)], full))
            n -= full * each
    return [x for v in room.values() for x in v]


def plan(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Sequences for counts[length] pieces of each length: ([(length, how many)], how many such sequences).

    Exact complements of up to three pieces, then best fit of what is left. Small pieces that complete a sequence early
    are missing in the end, so plans with complements of up to two, one and no pieces are made too and the one with the
    fewest sequences is taken: it is never worse than best fit alone.
    """
    plans = []
    for most in (3, 2, 1, 0):
        left = np.asarray(counts, np.int64).copy()
        left[0] = 0
        least = -(-int((left * np.arange(len(left))).sum()) // capacity)
        exact = _exact(left, capacity, most)
        plans.append(exact + _best_fit(left, capacity))
        if sum(n for _, n in plans[-1]) == least:
            break
    return min(plans, key=lambda p: sum(n for _, n in p))


def _places(found: list[tuple[list[tuple[int, int]], int]]):
    """The plan as arrays sorted by (length, first number): which pieces of a length go to which sequences."""
    rows, sequence, used = [], 0, {}
    for pattern, copies in found:
        offset = 0
        for length, each in pattern:
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * copies
            offset += length * each
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5).T


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document of docs (doc_id long, text) as pieces in sequences of at most `capacity` tokens.

    A document is its token ids and id 0. Only one with more than `capacity` is cut: its first piece may be shorter,
    the others are full. Null and empty texts are one piece of one token; repeated rows are packed each; an empty
    table gives no rows; other columns are ignored. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")
    pieces = _store.written(rows, "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = _store.written(per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "bases")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    where = _places(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = where[0] * (1 << 44) + where[1]
        for b in batches:
            length, number = b["length"].to_numpy(), b["rank"].to_numpy() + b["base"].to_numpy()
            at = np.searchsorted(key, length * (1 << 44) + number, "right") - 1
            nth, each = number - where[1][at], where[2][at]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(where[3][at] + nth // each), pa.array(where[4][at] + nth % each * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = pieces.join(per_part.hint("merge"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "base")
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
