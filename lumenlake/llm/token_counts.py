"""Token counts by a two-tier lookup on the map side.

A text is cut where a byte-level tokenizer cuts for certain, all cuts of a batch at once. The pre-tokens between cuts that are
frequent in the corpus are in a compact hash table of their exact bytes and token counts, which every worker gets by
broadcast and probes for a whole batch at a time; what is not there is encoded by the tokenizer and remembered in the worker.

No pre-token is ever a shuffle key. Which are frequent is found over all texts: each task counts its own, keeps those above
a share of its text, and these bounded summaries, one row a task, are merged in a tree.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake import workers

from ._arrow import mix, slices, utf8

LIMIT = 1024
#: Entries of the table at most: what has more than 1/FREQUENT of all pre-tokens.
FREQUENT = 32768
#: Pre-tokens and their counts that a worker remembers, and their longest bytes.
MEMO, MEMO_BYTES = 500_000, 64
#: Summaries that one task merges.
FAN_IN = 64
#: The longest pre-token of the table, in bytes: two 64-bit words.
WIDE = 16

# Classes of bytes: part of a character beyond ASCII, blank, other white space, letter, digit, apostrophe, any other.
_FAR, _BLANK, _WHITE, _LETTER, _DIGIT, _QUOTE, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:] = _FAR
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[9:14] = _WHITE
_CLASS[32], _CLASS[39] = _BLANK, _QUOTE
# Between which classes a byte-level tokenizer always cuts. Two of white space are looked at apart.
_CUT = np.zeros(64, bool)
for _a in (_FAR, _LETTER, _DIGIT, _QUOTE, _OTHER):
    for _b in (_BLANK, _WHITE):
        _CUT[_a * 8 + _b] = True
    _CUT[_WHITE * 8 + _a] = True
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _QUOTE), (_LETTER, _OTHER), (_DIGIT, _LETTER), (_DIGIT, _QUOTE), (_DIGIT, _OTHER), (_OTHER, _LETTER), (_OTHER, _DIGIT), (_QUOTE, _DIGIT)):
    _CUT[_a * 8 + _b] = True

#: White space beyond ASCII beside that of ASCII: runs of both are not cut by these rules.
_FAR_SPACE = rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_MIXED = rb"[\t-\r ](?=" + _FAR_SPACE + rb")|" + _FAR_SPACE + rb"(?=[\t-\r ])"


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each unit of each row begins: what is between two cuts is encoded alike wherever it stands."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    begin = np.zeros(n + 1, bool)
    begin[1:n] = _CUT[kind[:-1] << 3 | kind[1:]]
    begin[offsets[:-1]] = True  # rows; that of an empty row is its neighbour's or the end
    # The last of several white spaces goes with what follows it, or stands alone.
    white = np.append((kind == _BLANK) | (kind == _WHITE), True)
    white_end = np.zeros(n + 1, bool)
    white_end[offsets[1:]] = True  # the next byte is another row's
    at = np.flatnonzero(white[:-1] & ~(white[1:] | white_end[1:]))
    begin[at[at > 0]] |= white[at[at > 0] - 1]
    return np.flatnonzero(begin[:n])


def _lanes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of short units (WIDE at most) as two numbers."""
    padded = np.concatenate([data, np.zeros(WIDE, np.uint8)])
    lane = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)

    def part(at: np.ndarray, keep: np.ndarray) -> np.ndarray:
        mask = np.where(keep >= 8, full, (np.uint64(1) << (keep.astype(np.uint64) * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        return lane[at] & mask

    return part(starts, np.minimum(size, 8)), np.where(size > 8, part(starts + 8, np.clip(size - 8, 0, 8)), np.uint64(0))


def _hashed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(low ^ mix(high ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class Table:
    """Exact bytes of frequent pre-tokens with their token counts, open addressing at most a quarter full."""

    @classmethod
    def of(cls, arrays: tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Table:
        out = cls.__new__(cls)
        out.probes, out.low, out.high, out.size, out.tokens = arrays
        out.slots = len(out.low)
        return out

    def arrays(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Plain arrays, which any worker can read."""
        return self.probes, self.low, self.high, self.size, self.tokens

    def __init__(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, tokens: np.ndarray):
        self.slots = 1 << max(4, int(4 * len(low)).bit_length())
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.size, self.tokens = np.zeros(self.slots, np.uint8), np.zeros(self.slots, np.uint8)
        self.probes = 0
        left, at = np.arange(len(low)), (_hashed(low, high, size) % np.uint64(self.slots)).astype(np.int64)
        while len(left):  # each free slot takes the first that wants it
            self.probes += 1
            slot, first = np.unique(at[left], return_index=True)
            free = self.size[slot] == 0
            slot, own = slot[free], left[first[free]]
            self.low[slot], self.high[slot], self.size[slot], self.tokens[slot] = low[own], high[own], size[own], tokens[own]
            left = left[~np.isin(left, own)]
            at[left] = (at[left] + 1) % self.slots

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The token count of each, 0 for what is not there."""
        out = np.zeros(len(low), np.int64)
        at = (_hashed(low, high, size) % np.uint64(self.slots)).astype(np.int64)
        live = np.arange(len(low))
        for _ in range(self.probes):
            same = (self.low[at] == low[live]) & (self.high[at] == high[live]) & (self.size[at] == size[live])
            out[live[same]] = self.tokens[at[same]]
            on = ~same & (self.size[at] > 0)
            live, at = live[on], (at[on] + 1) % self.slots
            if not len(live):
                break
        return out


_SUMMARY = pa.schema([("low", pa.uint64()), ("high", pa.uint64()), ("size", pa.uint8()), ("n", pa.int64())])


def _added(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["low", "high", "size"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["low", "high", "size", "n"]).cast(_SUMMARY)


def _above(table: pa.Table, total: int, most: int) -> pa.Table:
    """What has more than 1/most of the total: at most `most` rows."""
    return table.filter(pa.array(table["n"].to_numpy() * most > total))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SUMMARY) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _counted(batch: pa.RecordBatch) -> tuple[pa.Table, int]:
    """How often each short unit is in a batch, and the number of all units."""
    data, offsets = utf8(batch["text"])
    begin = _cuts(data, offsets)
    size = np.diff(begin, append=len(data))
    short = size <= WIDE
    low, high = _lanes(data, begin[short], size[short])
    _, first, n = np.unique(_hashed(low, high, size[short]), return_index=True, return_counts=True)
    return pa.table([pa.array(low[first]), pa.array(high[first]), pa.array(size[short][first].astype(np.uint8)), pa.array(n)], schema=_SUMMARY), len(begin)


def _summaries(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, share = [_SUMMARY.empty_table()], 0, 4 * most
        for b in slices(batches, "text"):
            found, n = _counted(b)
            total += n
            held.append(_above(found, n, share))
            if sum(t.num_rows for t in held) > 16 * most:
                held = [_above(_added(held), total, share)]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([_packed(_above(_added(held), total, most))], pa.binary())], names=["total", "summary"])

    return run


def _merged(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [_SUMMARY.empty_table()], 0
        for b in batches:
            for n, blob in zip(b["total"].to_pylist(), b["summary"].to_pylist(), strict=True):
                total += n
                held = [_added([*held, pa.ipc.open_stream(blob).read_all()])]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([_packed(_above(held[0], total, most))], pa.binary())], names=["total", "summary"])

    return run


def frequent(docs: DataFrame, most: int = FREQUENT) -> pa.Table:
    """The frequent pre-tokens of docs (text) with their counts: at most `most` rows, whatever the corpus.

    A task sends what has more than 1/most of its own pre-tokens, and so does each step of merging: what is close to the
    share may be missing, what is far above it is not. Counts decide what is looked up where, never a result.
    """
    summary, parts = "total long, summary binary", docs.rdd.getNumPartitions()
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_summaries(most), summary)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = rows.repartition(parts).mapInArrow(_merged(most), summary)
    found = [pa.ipc.open_stream(r["summary"]).read_all() for r in rows.collect()]  # one row
    return found[0] if found else _SUMMARY.empty_table()


def _bytes_of(table: pa.Table) -> list[bytes]:
    both = np.stack([table["low"].to_numpy(), table["high"].to_numpy()], axis=1).astype("<u8").tobytes()
    return [both[WIDE * i : WIDE * i + n] for i, n in enumerate(table["size"].to_pylist())]


def _library(path: str) -> Callable[[str], int]:
    """How many tokens the library of the file gives a text: sentencepiece for .model, else tokenizers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _certain(path: str) -> list[str] | None:
    """The special strings of a byte-level tokenizer whose pre-tokens the cuts of this module keep apart; None for any other."""
    if path.endswith(".model"):
        return None
    import json

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    first = held.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
    return [t["content"] for t in held.get("added_tokens", [])] if plain and not held.get("normalizer") else None


class Counter:
    """Token counts of texts in batches: the table first, then what the worker remembers, then the tokenizer."""

    def __init__(self, path: str, table: Table | None):
        self.count, self.table, self.memo = _library(path), table, {}
        special = _certain(path)
        self.whole = re.compile(b"|".join([_MIXED, *(re.escape(s.encode()) for s in special)])) if special is not None else None

    def _one(self, unit: bytes) -> int:
        found = self.memo.get(unit)
        if found is None:
            found = self.count(unit.decode())
            if len(unit) <= MEMO_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[unit] = found
        return found

    def counts(self, text: pa.Array) -> np.ndarray:
        data, offsets = utf8(text)
        raw = data.tobytes()
        out = np.zeros(len(text), np.int64)
        if self.whole is None or self.table is None:
            whole = np.ones(len(text), bool)
        else:
            begin = _cuts(data, offsets)
            size = np.diff(begin, append=len(data))
            tokens, short = np.zeros(len(begin), np.int64), np.flatnonzero(size <= WIDE)
            tokens[short] = self.table.find(*_lanes(data, begin[short], size[short]), size[short])
            row = np.searchsorted(offsets, begin, "right") - 1
            whole = np.zeros(len(text), bool)  # a match over two rows sends at most a row too many
            whole[[int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.whole.finditer(raw)]] = True
            miss = np.flatnonzero((tokens == 0) & ~whole[row])
            tokens[miss] = [self._one(raw[a : a + n]) for a, n in zip(begin[miss].tolist(), size[miss].tolist(), strict=True)]
            np.add.at(out, row, tokens)
        for i in np.flatnonzero(whole):
            out[i] = self.count(raw[offsets[i] : offsets[i + 1]].decode())
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of each row of docs (doc_id long, text).

    Counts are those of the tokenizer's library without special tokens added, truncation or padding; a special string in a
    text is what the library makes of it. Null and empty texts have no bytes and no tokens; very long texts are counted
    whole, their pre-tokens one by one; rows with equal texts get equal counts and repeated rows one each; an empty table
    gives no rows; other columns are ignored. Tokenizers that do not cut as byte-level ones are asked for whole texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent: Broadcast | None = None
    if _certain(tokenizer_path) is not None:
        held = frequent(rows, most)
        units, count = _bytes_of(held), _library(tokenizer_path)
        tokens = np.array([count(u.decode()) for u in units], np.int64)  # at most WIDE each: a token is a byte at least
        table = Table(held["low"].to_numpy(), held["high"].to_numpy(), held["size"].to_numpy().astype(np.int64), tokens)
        sent = docs.sparkSession.sparkContext.broadcast(table.arrays())  # at most 8 * FREQUENT slots of 18 bytes
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = workers.kept("token counts", run_id, lambda: Counter(tokenizer_path, Table.of(sent.value) if sent else None))
        for b in slices(batches, "text"):
            n = counter.counts(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(utf8(b["text"])[1])), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
