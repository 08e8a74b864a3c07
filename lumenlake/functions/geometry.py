"""Box geometry as columns. A box is a struct x0, y0, x1, y1 of doubles in pixels; inverted boxes have no area."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
REGION = f"struct<box:{BOX},source:string,label:string>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def from_list(values: Column) -> Column:
    """A box from an array of four numbers; null if there are not four."""
    return F.when(F.size(values) == 4, box(*(F.get(values, F.lit(i)) for i in range(4))))


def to_list(b: Column) -> Column:
    return F.array(b.x0, b.y0, b.x1, b.y1)


def area(b: Column) -> Column:
    return F.greatest(b.x1 - b.x0, F.lit(0.0)) * F.greatest(b.y1 - b.y0, F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, F.try_divide(both, union)).otherwise(F.lit(0.0))


def gap(a: Column, b: Column) -> Column:
    """The distance between two boxes, 0 if they touch."""
    dx = F.greatest(b.x0 - a.x1, a.x0 - b.x1, F.lit(0.0))
    dy = F.greatest(b.y0 - a.y1, a.y0 - b.y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def close(a: Column, b: Column, threshold: Column | float = 0.0) -> Column:
    """Whether boxes overlap or lie within threshold, which is included."""
    return (iou(a, b) > 0) | (gap(a, b) <= threshold)


def covered(subjects: Column, references: Column, threshold: Column | float) -> Column:
    """Whether each of an array of boxes has a close one in another; true without subjects."""
    return F.forall(subjects, lambda s: F.exists(references, lambda r: close(s, r, threshold)))


def any_close(left: Column, right: Column, threshold: Column | float) -> Column:
    return F.exists(left, lambda a: F.exists(right, lambda b: close(a, b, threshold)))


def threshold(fraction: Column | float, width: Column, height: Column) -> Column:
    return fraction * F.greatest(width, height)


def grid(width: Column, height: Column, columns: int = 4, rows: int = 4) -> Column:
    """The cells of an image, row by row."""
    w, h = width / F.lit(float(columns)), height / F.lit(float(rows))
    cell = lambda r, c: box(c * w, r * h, (c + 1) * w, (r + 1) * h)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: cell(r, c))))


def rank_regions(boxes: Column, labels: Column, width: Column, height: Column) -> Column:
    """Boxes as regions by area, largest first and the given order among equals; the grid where there are none."""
    index = F.sequence(F.lit(0), F.greatest(F.size(boxes) - 1, F.lit(0)))
    keyed = F.transform(index, lambda i: F.struct((-area(F.get(boxes, i))).alias("k"), i.alias("i"), F.get(boxes, i).alias("box"), F.get(labels, i).alias("label")))
    ranked = F.transform(F.array_sort(keyed), lambda x: F.struct(x.box.alias("box"), F.lit("model").alias("source"), x.label.alias("label")))
    cells = F.transform(grid(width, height), lambda b: F.struct(b.alias("box"), F.lit("grid").alias("source"), F.lit("grid").alias("label")))
    return F.when(F.size(boxes) > 0, ranked).otherwise(cells)


def top(regions: Column, rank: int = 0) -> Column:
    """The region of that rank, or the first where there are fewer."""
    return F.coalesce(F.get(regions, F.lit(rank)), F.get(regions, F.lit(0)))


def head(worker: Column, scale: float = 0.22) -> Column:
    """A centred band at the top of a worker's box."""
    height = (worker.y1 - worker.y0) * scale
    width = F.least(worker.x1 - worker.x0, height * 1.3)
    x0 = worker.x0 + (worker.x1 - worker.x0 - width) / 2
    return box(x0, worker.y0, x0 + width, worker.y0 + height)


def to_frame(b: Column, width: Column, height: Column) -> Column:
    """Rounded half to even and clipped to the image; null for what has no pixel left."""
    x0, y0 = (F.greatest(F.bround(v, 0), F.lit(0.0)) for v in (b.x0, b.y0))
    x1, y1 = F.least(F.bround(b.x1, 0), width), F.least(F.bround(b.y1, 0), height)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))
