"""How sure a rate is: bootstrap intervals in one pass, and a permutation test between two classes.

The bootstrap is Poisson's: in each replicate a row counts 0, 1, 2, ... times, drawn from a digest of its key, so rows need no
order and no second look, replicates are added up before the shuffle, and the same seed gives the same interval anywhere.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


REPLICATES, LEVEL = 200, 0.95
#: Sixteen-bit draws in a digest.
_DRAWS = 8


def thresholds() -> list[int]:
    """A sixteen-bit draw counts as often as it reaches one of these: the distribution of a Poisson count of mean 1."""
    out, total = [], 0.0
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(65536 * total))
    return [t for t in out if t < 65536]


def bootstrap(rows: DataFrame, key: Column, cls: str, value: Column, seed: int, replicates: int = REPLICATES, level: float = LEVEL) -> DataFrame:
    """cls, n, estimate, low and high of each class: the mean of value and its percentile interval over the replicates.

    key tells rows apart; value is a number or boolean, null and NaN are left out; a class without a value has no row. Of
    one row the interval is that row's value. replicates is a multiple of 8.
    """
    if replicates < _DRAWS or replicates % _DRAWS:
        raise ValueError("replicates must be a multiple of 8")
    plain = rows.select(key.cast("string").alias("_key"), F.col(cls).alias("_c"), value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    digest = F.md5(F.concat_ws("#", "_key", F.lit(str(seed)), F.col("_d").cast("string")))
    each = plain.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(replicates // _DRAWS - 1)))).withColumn("_h", digest)
    each = each.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(_DRAWS - 1))))
    draw = F.conv(F.substring("_h", F.col("_i") * 4 + 1, F.lit(4)), 16, 10).cast("int")
    times = sum(((draw >= t).cast("long") for t in thresholds()), F.lit(0).cast("long"))
    each = each.select("_c", (F.col("_d") * _DRAWS + F.col("_i")).alias("_r"), "_v", times.alias("_w"))
    drawn = each.groupBy("_c", "_r").agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"))
    means = drawn.select("_c", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("_m"))  # `replicates` rows a class
    tail = (1 - level) / 2
    spread = means.groupBy("_c").agg(F.percentile("_m", tail).alias("low"), F.percentile("_m", 1 - tail).alias("high"))
    found = plain.groupBy("_c").agg(F.count("*").alias("n"), F.avg("_v").alias("estimate")).alias("f")
    both = found.join(spread.alias("s"), F.col("f._c").eqNullSafe(F.col("s._c")))
    return both.select(F.col("f._c").alias(cls), "n", "estimate", "low", "high")


def permuted(hits_a: int, n_a: int, hits_b: int, n_b: int) -> float:
    """How often classes dealt anew to the same rows differ in their rates by as much at least: exact, from counts alone.

    All deals have the hits of the first class by the hypergeometric distribution. What lies more than 40 deviations from
    its mean has no weight in doubles and is left out, so the sum is short for any number of rows.
    """
    n, hits = n_a + n_b, hits_a + hits_b
    if not n_a or not n_b:
        return 1.0
    mean = n_a * hits / n
    deviation = math.sqrt(max(n_a * n_b * hits * (n - hits), 0) / (n * n * max(n - 1, 1)))
    low, high = max(0, hits - n_b), min(n_a, hits)
    k = np.arange(max(low, math.floor(mean - 40 * deviation - 1)), min(high, math.ceil(mean + 40 * deviation + 1)) + 1)
    log = lambda top, part: math.lgamma(top + 1) - math.lgamma(part + 1) - math.lgamma(top - part + 1)
    share = np.exp(np.array([log(hits, int(i)) + log(n - hits, n_a - int(i)) - log(n, n_a) for i in k]))
    apart = abs(k * n - n_a * hits)  # the difference of rates, times n_a * n_b
    return float(min(1.0, share[apart >= abs(hits_a * n - n_a * hits)].sum()))


def differences(rows: DataFrame, cls: str, hit: Column) -> DataFrame:
    """first, second, difference (of their rates) and p_value for all pairs of classes; rows with a null hit are left out.

    One pass counts rows and hits of each class: a row a class reaches the driver, classes being few (as those of rules).
    """
    counted = rows.filter(hit.isNotNull() & F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).orderBy(cls).collect()
    out = [(a[cls], b[cls], a["hits"] / a["n"] - b["hits"] / b["n"], permuted(a["hits"], a["n"], b["hits"], b["n"])) for a, b in combinations(counted, 2)]
    return rows.sparkSession.createDataFrame(out, "first string, second string, difference double, p_value double")
