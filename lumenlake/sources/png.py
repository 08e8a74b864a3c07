"""PNG as arrays: the five row filters, done and undone for many pictures of one size together."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel has, by colour type: grey, RGB, palette, grey with alpha, RGB with alpha.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predictions(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> list[np.ndarray]:
    """What each of the five filters takes a sample to be from its neighbours (of a signed type)."""
    guess = left + up - corner
    to_left, to_up, to_corner = abs(guess - left), abs(guess - up), abs(guess - corner)
    paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
    return [np.zeros_like(left), left, up, (left + up) >> 1, paeth]


def encode(pixels: np.ndarray) -> bytes:
    """An RGB picture (rows, columns, 3), each row by the filter that leaves the least absolute differences."""
    height, width = pixels.shape[:2]
    wide = np.zeros((height + 1, width + 1, 3), np.int16)
    wide[1:, 1:] = pixels
    found = np.stack([(wide[1:, 1:] - p).astype(np.uint8) for p in _predictions(wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1])])
    cost = abs(found.view(np.int8).astype(np.int16)).reshape(5, height, -1).sum(axis=2, dtype=np.int64)
    kind = cost.argmin(axis=0)
    rows = np.concatenate([kind[:, None].astype(np.uint8), found[kind, np.arange(height)].reshape(height, -1)], axis=1)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


@dataclass
class Coded:
    """A picture whose rows are still filtered."""

    height: int
    width: int
    depth: int
    colour: int
    palette: np.ndarray
    rows: np.ndarray  # height x (1 + bytes a row): the filter, then what it left

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return self.height, self.width, self.depth, self.colour


def read(data: bytes) -> Coded:
    """The parts of a PNG file; ValueError for what is none, is cut short or damaged, or is interlaced."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, head, palette, packed, ended = 8, None, np.zeros((0, 3), np.uint8), [], False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended:
        raise ValueError("cut short")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced or colour not in _SAMPLES or depth not in (1, 2, 4, 8, 16):
        raise ValueError("interlaced" if interlaced else f"colour type {colour} of {depth} bits")
    stride = (width * _SAMPLES[colour] * depth + 7) // 8
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"damaged data: {e}") from e
    if len(raw) != height * (1 + stride):
        raise ValueError("wrong size of data")
    rows = np.frombuffer(raw, np.uint8).reshape(height, 1 + stride)
    if height and rows[:, 0].max() > 4:
        raise ValueError("unknown filter")
    return Coded(height, width, depth, colour, palette, rows)


def unfilter(rows: np.ndarray, unit: int) -> np.ndarray:
    """The rows of pictures (pictures, height, 1 + stride) without their filters; unit: bytes from a sample to that left of it.

    A sample needs those left of it, above it and above left, so all samples on a falling diagonal, of every picture, are
    worked out at once.
    """
    n, height, stride = rows.shape[0], rows.shape[1], rows.shape[2] - 1
    kind, width = rows[:, :, 0], -(-stride // unit)
    if not kind.any():
        return rows[:, :, 1:]
    left_over = np.zeros((n, height, width * unit), np.uint8)
    left_over[:, :, :stride] = rows[:, :, 1:]
    left_over = left_over.reshape(n, height, width, unit)
    out = np.zeros((n, height + 1, width + 1, unit), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        x = d - y
        guess = np.choose(kind[:, y, None], _predictions(out[:, y + 1, x], out[:, y, x + 1], out[:, y, x]))
        out[:, y + 1, x + 1] = (left_over[:, y, x] + guess) & 255
    return out[:, 1:, 1:].astype(np.uint8).reshape(n, height, -1)[:, :, :stride]


def _rgb(plain: np.ndarray, like: Coded, palettes: list[np.ndarray]) -> np.ndarray:
    """Rows without filters as RGB, eight bits a sample; alpha is left out."""
    n, samples = len(plain), _SAMPLES[like.colour]
    if like.depth == 16:
        plain = plain[:, :, ::2]
    elif like.depth < 8:
        bits = np.unpackbits(plain, axis=2).reshape(n, like.height, -1, like.depth)
        plain = (bits << np.arange(like.depth - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)[:, :, : like.width]
        if like.colour != 3:
            plain = plain * np.uint8(255 // ((1 << like.depth) - 1))
    pixels = plain.reshape(n, like.height, like.width, samples)
    if like.colour == 3:
        if any(p.max(initial=0) >= len(c) for p, c in zip(pixels, palettes, strict=True)):
            raise ValueError("a colour that the palette lacks")
        return np.stack([c[p[..., 0]] for p, c in zip(pixels, palettes, strict=True)])
    return pixels[..., :3] if samples > 2 else np.repeat(pixels[..., :1], 3, axis=3)


def decode(files: list[bytes | None], most: int = 1 << 22) -> list[np.ndarray | str | None]:
    """For each file its RGB pixels, or why there are none; null files stay null. Pictures of one size, up to `most` pixels, go together."""
    out: list[np.ndarray | str | None] = [None] * len(files)
    groups: dict[tuple, list[list[tuple[int, Coded]]]] = {}
    for i, data in enumerate(files):
        if data is None:
            continue
        try:
            coded = read(data)
        except (ValueError, struct.error) as e:
            out[i] = str(e)
            continue
        own = groups.setdefault(coded.shape, [[]])
        if (len(own[-1]) + 1) * coded.height * coded.width > most and own[-1]:
            own.append([])
        own[-1].append((i, coded))
    for group in (g for own in groups.values() for g in own):
        first = group[0][1]
        plain = unfilter(np.stack([c.rows for _, c in group]), max(1, _SAMPLES[first.colour] * first.depth // 8))
        for k, (i, c) in enumerate(group):
            try:
                out[i] = _rgb(plain[k : k + 1], c, [c.palette])[0]
            except ValueError as e:
                out[i] = str(e)
    return out
