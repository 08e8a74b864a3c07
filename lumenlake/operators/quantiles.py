"""Exact quantiles by distributed selection.

Values are counted, dealt to ranges of (group, value) and sorted inside each. What each range holds of each group is one number,
and tells which range a rank is in; only the rows of that range are ranked. However large a group is, a task gets no more
than a range, and a value that many rows have is one row with a count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.sources import tables

from . import ordering


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def exact(rows: DataFrame, keys: list[str], value: Column, points: dict[str, float]) -> DataFrame:
    """keys and for each name of points the quantile of value at its point (0 to 1), between two values by their distance.

    Null and NaN are left out; groups without a number have no row. Without keys there is one row, or none.
    """
    if not points or not all(0 <= p <= 1 for p in points.values()):
        raise ValueError("points must be from 0 to 1")
    names = {f"_k{i}": k for i, k in enumerate(keys)}
    number = rows.select(*(F.col(k).alias(n) for n, k in names.items()), (value.cast("double") + F.lit(0.0)).alias("_v"))
    counted = number.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*names, "_v").agg(F.count("*").alias("_n"))
    ranged = ordering.in_ranges(counted, [*map(F.col, names), F.col("_v")])
    ranged = tables.stored(ranged.withColumn("_range", ordering.range_of()).drop("_at"), "ranges")
    # What each range holds of each group, and what comes before it: a row for each range, and for each group more.
    group = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    held = ranged.groupBy(*names, "_range").agg(F.sum("_n").alias("_held"))
    upto = F.sum("_held").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumns({"_before": upto - F.col("_held"), "_total": F.sum("_held").over(group)})
    at = [F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("_total") - 1)).alias("at")) for i, p in enumerate(points.values())]
    ranks = held.select(*names, "_range", "_before", "_held", F.explode(F.array(*at)).alias("_p"))
    ranks = ranks.select(*names, "_range", "_before", "_held", "_p.i", "_p.at", F.explode(F.array(F.floor("_p.at"), F.ceil("_p.at"))).alias("_rank"))
    ranks = ranks.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_held"))).distinct()
    ranks = ranks.select(*(F.col(c).alias(c) for c in (*names, "_range", "i", "at")), (F.col("_rank") - F.col("_before")).alias("_nth"), "_rank")
    # The rows of ranges that hold a rank, counted up inside the range.
    asked = ranks.select(*(F.col(c).alias(c) for c in (*names, "_range"))).distinct()
    on = [*names, "_range"]
    wanted = ranged.join(asked, _same(ranged, asked, on), "left_semi")
    wanted = wanted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    inside = (ranks["_nth"] < wanted["_upto"]) & (ranks["_nth"] >= wanted["_upto"] - wanted["_n"])
    found = ranks.join(wanted, _same(ranks, wanted, on) & inside).select(*(ranks[n] for n in names), "i", "at", "_rank", "_v")

    def between(i: int) -> Column:
        own = F.col("i") == i
        low, high = (F.max(F.when(own & (F.col("_rank") == side("at")), F.col("_v"))) for side in (F.floor, F.ceil))
        return low + (high - low) * F.max(F.when(own, F.col("at") - F.floor("at")))

    out = found.groupBy(*names).agg(*(between(i).alias(name) for i, name in enumerate(points)))
    return out.filter(F.col(next(iter(points))).isNotNull()).withColumnsRenamed(names)
