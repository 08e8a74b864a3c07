"""Image perturbations and overlays: numpy on decoded pixels (rows, columns, RGB), batch by batch.

Pixels travel as bytes with height and width; a scan's image decoder is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Pixels = np.ndarray


def _kernel(radius: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * radius)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    return k / k.sum()


def blur(image: Pixels, radius: float = 8.0) -> Pixels:
    """Gaussian, by rows and then by columns; edges repeat."""
    if radius <= 0:
        return image.copy()
    k = _kernel(radius)
    out = image.astype(float)
    for axis in (0, 1):
        wide = np.pad(out, [(len(k) // 2,) * 2 if a == axis else (0, 0) for a in range(out.ndim)], mode="edge")
        out = sum(w * np.take(wide, np.arange(i, i + image.shape[axis]), axis=axis) for i, w in enumerate(k))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def low_light(image: Pixels, gamma: float = 2.5) -> Pixels:
    return (np.power(image / 255.0, gamma) * 255).astype(np.uint8)


def occlude(image: Pixels, fraction: float = 0.2) -> Pixels:
    """A black square of that share of the area, in the middle."""
    h, w = image.shape[:2]
    side = round((fraction * w * h) ** 0.5)
    top, left = (h - side) // 2, (w - side) // 2
    out = image.copy()
    out[max(top, 0) : max(top + side, 0), max(left, 0) : max(left + side, 0)] = 0
    return out


#: A colour's share of its grey, of 65536. Fixed values.
GREY = np.array([19595, 38470, 7471])


def contrast_shift(image: Pixels, factor: float = 0.3) -> Pixels:
    """Blended with the mean grey, of whole greys: 1 changes nothing, less flattens. Fractions are cut off, in single precision."""
    grey = np.float32(int(((image @ GREY + 32768) >> 16).mean() + 0.5))
    return np.clip(grey + np.float32(factor) * (image.astype(np.float32) - grey), 0, 255).astype(np.uint8)


def _frame(box: tuple[float, ...], image: Pixels) -> tuple[int, int, int, int] | None:
    h, w = image.shape[:2]
    x0, y0, x1, y1 = (round(v) for v in box)
    x0, y0, x1, y1 = max(x0, 0), max(y0, 0), min(x1, w), min(y1, h)
    return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else None


def mask_region(image: Pixels, box: tuple[float, ...], mode: str = "black", radius: float = 25.0) -> Pixels:
    """The box blackened or blurred; a box outside changes nothing."""
    if mode not in ("black", "blur"):
        raise ValueError(f"unknown mask mode: {mode}")
    out, at = image.copy(), _frame(box, image)
    if at:
        x0, y0, x1, y1 = at
        out[y0:y1, x0:x1] = 0 if mode == "black" else blur(image[y0:y1, x0:x1], radius)
    return out


def _bilinear(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - abs(x), 0)


def _bicubic(x: np.ndarray) -> np.ndarray:
    x = abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((x - 5) * x + 8) * x - 4, 0) * -0.5)


#: Filters by their reach, in pixels of the source or, where it shrinks, of the result.
FILTERS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {"bilinear": (_bilinear, 1.0), "bicubic": (_bicubic, 2.0)}
_BITS = 22


def _weights(source: int, size: int, name: str) -> np.ndarray:
    """What each pixel of a line has of each of its source, as whole numbers of 2**-22."""
    kernel, reach = FILTERS[name]
    scale = source / size
    wide = max(scale, 1.0)
    centre = (np.arange(size)[:, None] + 0.5) * scale
    first, last = np.floor(np.maximum(centre - reach * wide + 0.5, 0)), np.floor(np.minimum(centre + reach * wide + 0.5, source))
    at = np.arange(source)[None, :]
    w = np.where((at >= first) & (at < last), kernel((at - centre + 0.5) / wide), 0)
    w = w / w.sum(axis=1, keepdims=True) * (1 << _BITS)
    return np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def resized(image: Pixels, height: int, width: int, name: str = "bicubic") -> Pixels:
    """Columns first, then rows, each rounded to whole levels."""
    out = image.astype(np.int64)
    for axis, size in ((1, width), (0, height)):
        if out.shape[axis] != size:
            summed = np.tensordot(_weights(out.shape[axis], size, name), out, (1, axis))  # the new axis comes first
            out = np.clip((np.moveaxis(summed, 0, axis) + (1 << (_BITS - 1))) >> _BITS, 0, 255)
    return out.astype(np.uint8)


def paste_patch(image: Pixels, box: tuple[float, ...], patch: Pixels) -> Pixels:
    """The patch resized to the rounded and clipped box; a box outside changes nothing."""
    out, at = image.copy(), _frame(box, image)
    if at:
        x0, y0, x1, y1 = at
        out[y0:y1, x0:x1] = resized(patch, y1 - y0, x1 - x0)
    return out


def hard_hat_patch(width: int = 60, height: int = 60) -> Pixels:
    """A yellow ellipse on skin tone."""
    out = np.full((height, width, 3), (235, 220, 200), np.uint8)
    y, x = np.mgrid[:height, :width]
    cx, cy, rx, ry = width / 2, (height - 4) / 2, (width - 4) / 2, (height - 8) / 2
    out[((x - cx) / rx) ** 2 + ((y - cy) / ry) ** 2 <= 1] = (255, 210, 0)
    return out


#: Letters of three by five pixels, rows from the top, for labels on pictures.
GLYPHS = {
    "a": ".#. #.# ### #.# #.#", "b": "##. #.# ##. #.# ##.", "c": ".## #.. #.. #.. .##", "d": "##. #.# #.# #.# ##.", "e": "### #.. ##. #.. ###", "f": "### #.. ##. #.. #..",
    "g": ".## #.. #.# #.# .##", "h": "#.# #.# ### #.# #.#", "i": "### .#. .#. .#. ###", "j": "..# ..# ..# #.# .#.", "k": "#.# #.# ##. #.# #.#", "l": "#.. #.. #.. #.. ###",
    "m": "#.# ### ### #.# #.#", "n": "##. #.# #.# #.# #.#", "o": ".#. #.# #.# #.# .#.", "p": "##. #.# ##. #.. #..", "q": ".#. #.# #.# .#. ..#", "r": "##. #.# ##. #.# #.#",
    "s": ".## #.. .#. ..# ##.", "t": "### .#. .#. .#. .#.", "u": "#.# #.# #.# #.# ###", "v": "#.# #.# #.# #.# .#.", "w": "#.# #.# ### ### #.#", "x": "#.# #.# .#. #.# #.#",
    "y": "#.# #.# .#. .#. .#.", "z": "### ..# .#. #.. ###", " ": "... ... ... ... ...",
}


def lettering(text: str) -> np.ndarray:
    """Where a line of text has ink; a character without a letter is a full block."""
    blocks = [[[c == "#" for c in row] + [False] for row in GLYPHS.get(ch, "### ### ### ### ###").split()] for ch in text.lower()]
    return np.concatenate([np.array(b, bool) for b in blocks], axis=1) if blocks else np.zeros((5, 0), bool)


def overlay_boxes(image: Pixels, boxes: list[tuple[float, ...]], labels: list[str | None] | None = None, colour: tuple[int, int, int] = (255, 0, 0), width: int = 3) -> Pixels:
    """Outlines of boxes, their corners cut to whole pixels and both included, growing inwards; what is outside is not drawn.

    Labels stand twelve rows above their box, or at the top, two columns in; boxes and labels go together as far as both
    reach. Inverted boxes have no outline.
    """
    out = image.copy()
    h, w = image.shape[:2]
    for box, label in zip(boxes, labels if labels is not None else [None] * len(boxes), strict=False):
        x0, y0, x1, y1 = (int(v) for v in box)
        if x1 >= x0 and y1 >= y0:
            x, y = np.arange(w), np.arange(h)
            across, down = (x >= x0) & (x <= x1), (y >= y0) & (y <= y1)
            left_right, top_bottom = across & ((x < x0 + width) | (x > x1 - width)), down & ((y < y0 + width) | (y > y1 - width))
            out[(down[:, None] & left_right[None, :]) | (top_bottom[:, None] & across[None, :])] = colour
        if label:
            _write(out, int(box[0] + 2), int(max(box[1] - 12, 0)), label, colour)
    return out


def _write(out: Pixels, left: int, top: int, text: str, colour: tuple[int, int, int]) -> None:
    ink = lettering(text)[max(-top, 0) :, max(-left, 0) :]
    left, top = max(left, 0), max(top, 0)
    ink = ink[: max(0, out.shape[0] - top), : max(0, out.shape[1] - left)]
    out[top : top + ink.shape[0], left : left + ink.shape[1]][ink] = colour


def overlay_heatmap(image: Pixels, heatmap: np.ndarray, alpha: float = 0.5, gamma: float = 1.0) -> Pixels:
    """Each pixel moved towards red, by up to alpha where the map is 1. The map is cut to 256 levels and then enlarged; so is the result."""
    levels = (np.clip(heatmap, 0.0, 1.0) ** gamma * 255).astype(np.uint8)
    share = (alpha * (resized(levels, *image.shape[:2], "bilinear") / 255.0))[..., None]
    return (image * (1 - share) + np.array([255.0, 0.0, 0.0]) * share).astype(np.uint8)


#: The image perturbations of the robustness metric by name.
PERTURBATIONS: dict[str, Callable[[Pixels], Pixels]] = {"blur": blur, "low_light": low_light, "occlude": occlude, "contrast_shift": contrast_shift}


def perturb(images: DataFrame, name: str, extra: dict[str, Callable[[Pixels], Pixels]] | None = None) -> DataFrame:
    """images (height, width, pixels as bytes, and any columns) with a perturbation of PERTURBATIONS or extra applied. Null pixels stay null."""
    change = (PERTURBATIONS | (extra or {}))[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, at = b["pixels"], b.schema.get_field_index("pixels")
            sizes = zip(b["height"].to_pylist(), b["width"].to_pylist(), strict=True)
            out = [change(np.frombuffer(p.as_buffer(), np.uint8).reshape(h, w, 3)).tobytes() if p.is_valid else None for p, (h, w) in zip(held, sizes, strict=True)]
            yield b.set_column(at, b.schema.field(at), pa.array(out, held.type))

    return images.mapInArrow(run, images.schema)


def paste_patches(images: DataFrame, patch: Pixels, box: str = "box") -> DataFrame:
    """images (height, width, pixels, box as struct of corners, and any columns) with the patch pasted into each box; null boxes change nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, h, w, at in zip(*(b[c].to_pylist() for c in ("pixels", "height", "width", box)), strict=True):
                whole = p is not None and at is not None and None not in at.values()
                out.append(paste_patch(np.frombuffer(p, np.uint8).reshape(h, w, 3), (at["x0"], at["y0"], at["x1"], at["y1"]), patch).tobytes() if whole else p)
            k = b.schema.get_field_index("pixels")
            yield b.set_column(k, b.schema.field(k), pa.array(out, b["pixels"].type))

    return images.mapInArrow(run, images.schema)


def overlay_heatmaps(images: DataFrame, map_height: int, map_width: int, alpha: float = 0.5, gamma: float = 1.0) -> DataFrame:
    """images (height, width, pixels, heatmap as map_height * map_width doubles in 0..1, and any columns) under their maps; null maps change nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, h, w, m in zip(b["pixels"].to_pylist(), b["height"].to_pylist(), b["width"].to_pylist(), b["heatmap"], strict=True):
                heat = np.array(m.as_py(), float).reshape(map_height, map_width) if m.is_valid else None
                out.append(p if p is None or heat is None else overlay_heatmap(np.frombuffer(p, np.uint8).reshape(h, w, 3), heat, alpha, gamma).tobytes())
            at = b.schema.get_field_index("pixels")
            yield b.set_column(at, b.schema.field(at), pa.array(out, b["pixels"].type))

    return images.mapInArrow(run, images.schema)
