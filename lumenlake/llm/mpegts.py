"""Media columns in MPEG transport streams (ISO/IEC 13818-1).

A payload of whole 576-byte sample blocks is one program with one private elementary stream: program tables, PES packets
with presentation timestamps, random-access points that carry the clock, continuity counters and adaptation-field
stuffing. Reading goes the other way: program tables first, then the counters, then the elementary packets.
All packets of a stream are built and read as one array.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._arrow import slices

BLOCK = 576
FILL = 255
#: Fixed values of the format and of our streams.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
PRIVATE_PES, PRIVATE_STREAM = 0x06, 0xBD
BLOCKS_PER_PES, PES_PER_ACCESS_POINT, PES_HEADER = 5, 8, 14
TICKS_PER_BLOCK = 90_000 * BLOCK // 48_000  # 8-bit samples at 48 kHz on the 90 kHz clock
FIRST_TICK = 90_000


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: polynomial 0x04C11DB7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _table(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A packet with one section."""
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section).ljust(PACKET, b"\xff")


_PAT = np.frombuffer(_table(PAT_PID, 0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")), np.uint8)
_PMT = np.frombuffer(_table(PMT_PID, 2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0"), np.uint8)


def pad(payload: bytes) -> bytes:
    """payload with bytes 255 up to a positive multiple of the block."""
    return payload + bytes([FILL]) * (max(1, -(-len(payload) // BLOCK)) * BLOCK - len(payload))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload that pad() made."""
    data = np.frombuffer(payload, np.uint8)
    if not len(data) or len(data) % BLOCK:
        raise ValueError("the payload must be whole blocks")
    per_pes = BLOCKS_PER_PES * BLOCK
    m = -(-len(data) // per_pes)
    size = np.full(m, per_pes)
    size[-1] = len(data) - (m - 1) * per_pes
    tick = FIRST_TICK + np.arange(m) * BLOCKS_PER_PES * TICKS_PER_BLOCK

    header = np.zeros((m, PES_HEADER), np.uint8)
    header[:, 2], header[:, 3] = 1, PRIVATE_STREAM
    length = size + PES_HEADER - 6
    header[:, 4], header[:, 5] = length >> 8, length & 255
    header[:, 6], header[:, 7], header[:, 8] = 0x84, 0x80, 5  # aligned data; a timestamp; its five bytes
    header[:, 9] = 0x21 | tick >> 29 & 0x0E
    header[:, 10], header[:, 11] = tick >> 22 & 255, tick >> 14 & 0xFE | 1
    header[:, 12], header[:, 13] = tick >> 7 & 255, tick << 1 & 0xFE | 1
    stream = np.empty(len(data) + PES_HEADER * m, np.uint8)
    whole = (m - 1) * (per_pes + PES_HEADER)
    inner = stream[:whole].reshape(m - 1, per_pes + PES_HEADER)
    inner[:, :PES_HEADER], inner[:, PES_HEADER:] = header[:-1], data[: (m - 1) * per_pes].reshape(m - 1, per_pes)
    stream[whole : whole + PES_HEADER], stream[whole + PES_HEADER :] = header[-1], data[(m - 1) * per_pes :]

    access = np.arange(m) % PES_PER_ACCESS_POINT == 0
    total = size + PES_HEADER
    packets = -(-(total + 8 * access) // (PACKET - 4))
    n, first = int(packets.sum()), np.cumsum(packets) - packets
    field = np.zeros(n, np.int64)  # bytes of adaptation field
    field[first[access]] = 8
    field[first + packets - 1] += packets * (PACKET - 4) - total - 8 * access  # stuffing in the last packet
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[first, 1] |= 0x40
    out[:, 3] = np.where(field > 0, 0x30, 0x10) | np.arange(n) % 16
    some = field > 0
    out[some, 4] = field[some] - 1
    out[field > 1, 5] = 0
    at, clock = first[access], tick[access]
    out[at, 5] = 0x50  # random access, clock reference
    for k, shift in enumerate((25, 17, 9, 1)):
        out[at, 6 + k] = clock >> shift & 255
    out[at, 10], out[at, 11] = (clock & 1) << 7 | 0x7E, 0
    out[np.arange(PACKET) >= 4 + field[:, None]] = stream

    tables = np.stack([np.tile(_PAT, (len(at), 1)), np.tile(_PMT, (len(at), 1))], axis=1)  # both before each access point
    tables[:, :, 3] |= (np.arange(len(at)) % 16).astype(np.uint8)[:, None]
    place = np.arange(n) + 2 * np.searchsorted(at, np.arange(n), "right")
    full = np.empty((n + 2 * len(at), PACKET), np.uint8)
    full[place] = out
    full[place[at] - 2], full[place[at] - 1] = tables[:, 0], tables[:, 1]
    return full.tobytes()


@dataclass
class Units:
    """What a stream holds: for each PES packet its timestamp, whether decoding can begin there, and where it ends in payload."""

    payload: bytes
    pts: np.ndarray
    random_access: np.ndarray
    ends: np.ndarray
    packets: int
    tables: int
    lost: int  # breaks of continuity


def _section(packet: np.ndarray, table_id: int) -> bytes:
    at = 5 + int(packet[4])
    size = 3 + (int(packet[at + 1]) << 8 & 0xF00 | int(packet[at + 2]))
    section = packet[at : at + size].tobytes()
    if section[0] != table_id or crc32_mpeg(section):
        raise ValueError("a damaged program table")
    return section[8:-4]


def demux(media: bytes) -> Units:
    """Parse program tables, check continuity, reassemble the first private stream. Raises ValueError for what is no such stream."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("a packet without its sync byte")
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    pats = np.flatnonzero(pid == PAT_PID)
    if not len(pats):
        raise ValueError("no program association table")
    body = _section(rows[pats[0]], 0)
    programs = {int.from_bytes(body[i : i + 2], "big"): int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(body), 4)}
    map_pid = next((v for k, v in programs.items() if k), None)
    maps = np.flatnonzero(pid == map_pid)
    if not len(maps):
        raise ValueError("no program map table")
    body = _section(rows[maps[0]], 2)
    at, es = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF), None
    while es is None and at < len(body):
        if body[at] == PRIVATE_PES:
            es = int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
        at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    own = rows[pid == es]
    lost = 0
    for group in (own, rows[pats], rows[maps]):
        count = group[group[:, 3] & 0x10 > 0, 3].astype(np.int64) & 15
        lost += int(((np.diff(count) - 1) % 16 != 0).sum())
    field = np.where(own[:, 3] & 0x20, own[:, 4].astype(np.int64) + 1, 0)
    field = np.where(own[:, 3] & 0x10, field, PACKET - 4)
    stream = own[np.arange(PACKET) >= 4 + field[:, None]]
    begin = own[:, 1] & 0x40 > 0
    if not len(own) or not begin[0]:
        raise ValueError("no start of an elementary packet")
    before = np.cumsum(PACKET - 4 - field) - (PACKET - 4 - field)
    start = before[begin]
    head = stream[start[:, None] + np.arange(PES_HEADER)].astype(np.int64)
    if (head[:, :3] != (0, 0, 1)).any() or (head[:, 7] & 0x80 == 0).any():
        raise ValueError("a damaged elementary packet")
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | head[:, 11] >> 1 << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    skip, size = 9 + head[:, 8], 6 + (head[:, 4] << 8 | head[:, 5])
    stop = np.append(start[1:], len(stream))
    if (start + size != stop).any():
        raise ValueError("an elementary packet of another length")
    keep = np.ones(len(stream), bool)
    for k in range(int(skip.max())):
        keep[start[skip > k] + k] = False
    flags = np.where(field > 1, own[:, 5], 0)
    return Units(stream[keep].tobytes(), pts, (flags & 0x40 > 0)[begin], np.cumsum(size - skip), len(rows), len(pats) + len(maps), lost)


def media_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column: each text (null: empty), padded, as a transport stream. A column of that name is replaced."""
    rows = docs.drop(media)
    schema = StructType([*rows.schema.fields, StructField(media, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([mux(pad((t or "").encode())) for t in b[text].to_pylist()], pa.binary())], names=[*b.schema.names, media])

    return rows.mapInArrow(run, schema)


def access_units(streams: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each elementary packet of each stream: key, unit, pts, random_access, payload. Null streams give none."""
    rows = streams.filter(F.col(media).isNotNull()).select(F.col(key).cast("long").alias(key), media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media):
            for k, m in zip(b[key].to_pylist(), b[media].to_pylist(), strict=True):
                u = demux(m)
                first = np.concatenate([[0], u.ends[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(u.pts), pa.int64()), pa.array(np.arange(len(u.pts), dtype=np.int32)), pa.array(u.pts), pa.array(u.random_access), pa.array([u.payload[a:z] for a, z in zip(first, u.ends, strict=True)], pa.binary())], names=[key, "unit", "pts", "random_access", "payload"])

    return rows.mapInArrow(run, f"`{key}` long, unit int, pts long, random_access boolean, payload binary")


def digests(docs: DataFrame) -> DataFrame:
    """Store each text as a stream, read the stored bytes back and describe both. Equal texts have equal values.

    Returns doc_id, n_bytes (before padding), payload_bytes, payload_sha256 and tail_crc32 (of what was read back),
    media_bytes, media_sha256, feature (packets, elementary packets, access points, first and last timestamp, breaks of
    continuity and the payload's mean byte), and for each elementary packet its timestamp (pts) and whether it can be
    accessed at random (random_access). Null texts are empty; an empty text is one block of filling; repeated rows and
    null doc_ids keep their rows; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                raw = (text or "").encode()
                media = mux(pad(raw))
                u = demux(media)
                feature = f"packets={u.packets};pes={len(u.pts)};access={int(u.random_access.sum())};pts={u.pts[0]}-{u.pts[-1]};lost={u.lost};mean={np.frombuffer(u.payload, np.uint8).mean():.3f}"
                found = (doc, len(raw), len(u.payload), hashlib.sha256(u.payload).hexdigest(), zlib.crc32(u.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, u.pts, u.random_access)
                for column, v in zip(out, found, strict=True):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<boolean>")
