"""Heat maps from recorded attention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import heatmaps


def heat_maps(targets: DataFrame, attention: DataFrame, keys: list[str], size: int = 576) -> DataFrame:
    """keys, heatmap (size cells) and n_generated_tokens for each row of targets.

    attention: keys, step (a generated token) and weights, a row for each layer and head. Weights are averaged over the
    rows of a step and then over steps; the first entry and what follows the image cells is dropped; what is left is
    scaled to 0..1. Without attention the map is zero.
    """
    cells = attention.select(*keys, "step", F.posexplode("weights").alias("_at", "_w"))
    mean = cells.groupBy(*keys, "step", "_at").agg(F.avg("_w").alias("_w")).groupBy(*keys, "_at").agg(F.avg("_w").alias("_w"), F.count("*").alias("_n"))
    rows = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_w"))), lambda x: x["_w"]).alias("_row"), F.max("_n").alias("_n"))
    held = targets.select(*keys).join(rows, keys, "left")
    empty = F.array_repeat(F.lit(0.0), size)
    return held.select(*keys, F.when(F.col("_row").isNull(), empty).otherwise(heatmaps.normalised(F.col("_row"), size)).alias("heatmap"), F.coalesce("_n", F.lit(0)).cast("int").alias("n_generated_tokens"))
