"""Attention maps as flat arrays of doubles. What does not apply is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.5


def total(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)


def top_mass_ratio(cells: Column, k: int) -> Column:
    """The share of the k largest cells; null where nothing is above zero in sum."""
    if k < 1:
        raise ValueError("k must be at least 1")
    largest = F.slice(F.sort_array(cells, asc=False), 1, k)
    return F.when(total(cells) > 0, total(largest) / total(cells))


def count_above(cells: Column, threshold: float = THRESHOLD) -> Column:
    return F.size(F.filter(cells, lambda x: ~F.isnan(x) & (x >= threshold)))


def min_max(cells: Column) -> Column:
    """Shifted to 0 and scaled to 1; a constant map becomes zeros."""
    low = F.array_min(cells)
    span = F.array_max(cells) - low
    return F.transform(cells, lambda x: F.when(span > 0, F.try_divide(x - low, span)).otherwise(F.lit(0.0)))


def patch_cells(attention: Column, size: int = 576) -> Column:
    """The image cells of an attention row, whose first entry is no cell."""
    return F.slice(attention, 2, size)


def normalised(attention: Column, size: int = 576) -> Column:
    """The heat map of an attention row: its image cells, then scaled among themselves."""
    return min_max(patch_cells(attention, size))


def scored(source: Column, cells: Column, tokens: Column) -> list[Column]:
    """n_generated_tokens, both mass ratios, the number of large cells and excluded_reason of a region's heat map.

    A region of the grid was found by no phrase, so there is no map for it: no tokens, null scores and the reason.
    """
    grid = source == "grid"
    own = lambda c: F.when(~grid, c)
    return [
        F.when(grid, F.lit(0)).otherwise(tokens).alias("n_generated_tokens"),
        own(top_mass_ratio(cells, 5)).alias("topk5_mass_ratio"),
        own(top_mass_ratio(cells, 20)).alias("topk20_mass_ratio"),
        own(count_above(cells).cast("double")).alias("regions_above_0.5"),
        F.when(grid, "grid_fallback_no_box").alias("excluded_reason"),
    ]
