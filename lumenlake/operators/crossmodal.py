"""Agreement of attention with boxes: how much of a heat map lies in a box, whatever its size, from four numbers.

A map's summed-area table has at each corner of its cells what lies above and left of it. It is made once a map; the mass in
any box is then a sum of four of its entries, in plain columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

Size = tuple[int, int]


def summed_area(maps: DataFrame, size: Size, heatmap: str = "heatmap") -> DataFrame:
    """maps with area ((rows + 1) * (columns + 1) sums) and peak (the first of the largest cells) in place of heatmap.

    size: rows and columns. NaN counts as nothing; null maps, and those of another size, have null area and peak.
    """
    keep, (h, w) = [c for c in maps.columns if c != heatmap], size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b[heatmap]
            good = np.array([x.is_valid and len(x) == h * w for x in lists], bool)
            cells = np.array([x.as_py() for x, ok in zip(lists, good, strict=True) if ok], float).reshape(-1, h, w)
            cells = np.nan_to_num(cells, nan=0.0)
            area = np.zeros((len(cells), h + 1, w + 1))
            area[:, 1:, 1:] = cells.cumsum(axis=1).cumsum(axis=2)
            own = iter(zip(area.reshape(len(cells), -1), cells.reshape(len(cells), -1).argmax(axis=1), strict=True))
            rows = [next(own) if ok else (None, None) for ok in good]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32())], names=[*keep, "area", "peak"])

    plain = maps.select(*keep, F.col(heatmap).cast("array<double>").alias(heatmap))
    return plain.mapInArrow(run, StructType([f for f in plain.schema if f.name in keep] + [StructField("area", ArrayType(DoubleType())), StructField("peak", IntegerType())]))


def _edge(at: Column, cells: int, length: float) -> Column:
    """The first cell whose centre is not before at, from 0 to cells."""
    return F.greatest(F.lit(0), F.least(F.lit(cells), F.ceil(at * cells / length - 0.5).cast("int")))


def _edges(box: Column, size: Size, frame: tuple[float, float]) -> list[Column]:
    (h, w), (height, width) = size, frame
    return [_edge(box.x0, w, width), _edge(box.y0, h, height), _edge(box.x1, w, width), _edge(box.y1, h, height)]


def mass_in(area: Column, box: Column, size: Size, frame: tuple[float, float]) -> Column:
    """The share of a map's mass in the cells whose centre is in box; frame: height and width in the box's units. Null without mass."""
    left, top, right, bottom = _edges(box, size, frame)
    right, bottom = F.greatest(left, right), F.greatest(top, bottom)
    at = lambda y, x: F.get(area, y * (size[1] + 1) + x)
    total = F.get(area, F.lit((size[0] + 1) * (size[1] + 1) - 1))
    inside = at(bottom, right) - at(top, right) - at(bottom, left) + at(top, left)
    return F.when(total > 0, inside / total)


def points_at(peak: Column, box: Column, size: Size, frame: tuple[float, float]) -> Column:
    """Whether the centre of the map's largest cell is in box."""
    left, top, right, bottom = _edges(box, size, frame)
    x, y = peak % size[1], F.floor(peak / size[1])
    return (x >= left) & (x < right) & (y >= top) & (y < bottom)
