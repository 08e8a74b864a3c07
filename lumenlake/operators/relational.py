"""The relational layer: key joins, integrity checks, rates by class, shares, extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import rules


def semi(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is among keys: what should be done before anything expensive."""
    return rows.join(keys.select(*on), on, "left_semi")


def missing(targets: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Targets that were not found."""
    return targets.join(found.select(*on), on, "left_anti")


def cross_with(rows: DataFrame, names: list[str], column: str) -> DataFrame:
    """Each row once for each of a few names."""
    return rows.withColumn(column, F.explode(F.array(*map(F.lit, names))))


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by a total order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def rate(value: Column) -> Column:
    """The mean of numbers or booleans without null and NaN."""
    number = value.cast("double")
    return F.avg(F.when(~F.isnan(number), number))


def rate_by(rows: DataFrame, key: str, value: Column, name: str = "rate") -> DataFrame:
    return rows.groupBy(key).agg(rate(value).alias(name), F.count("*").alias("n"))


def rate_by_class(rows: DataFrame, value: Column, cls: str = "primary_class") -> list[Column]:
    """overall, each class and n, for one aggregation over all rows."""
    return [rate(value).alias("overall"), *(rate(F.when(F.col(cls) == c, value.cast("double"))).alias(c) for c in rules.CLASSES), F.count("*").alias("n")]


def rates_long(rows: DataFrame, value: Column, cls: str = "primary_class", rule: str = "assigned_rule_id") -> DataFrame:
    """level, class, rule, rate and n: overall, by class, by rule and by both, from one pass over rows.

    level is `overall`, `class`, `rule` or `class_rule`; what a level does not tell apart is null. A class without rows has
    its row of level class, with a null rate and n 0.
    """
    found = rows.select(F.col(cls).alias("c"), F.col(rule).alias("r"), value.cast("double").alias("v"))
    sets = found.groupingSets([["c", "r"], ["c"], ["r"], []], "c", "r").agg(F.grouping_id("c", "r").alias("g"), rate(F.col("v")).alias("rate"), F.count("*").alias("n"))
    level = F.element_at(F.array(*map(F.lit, ("class_rule", "class", "rule", "overall"))), F.col("g").cast("int") + 1)
    found = sets.select(level.alias("level"), F.col("c").alias("class"), F.col("r").alias("rule"), "rate", "n")
    names = rows.sparkSession.createDataFrame([("class", c) for c in rules.CLASSES], "level string, class string")
    none = names.join(found.filter("level = 'class'").select("level", "class"), ["level", "class"], "left_anti")
    return found.unionByName(none.select("level", "class", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("double").alias("rate"), F.lit(0).cast("long").alias("n")))


def shares(rows: DataFrame, *keys: str) -> DataFrame:
    """Each value's count and its share of all rows: one pass over rows, the total is that of the counts."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def corrected_rate(hit: Column, eligible: Column) -> list[Column]:
    """A rate over all rows and over those that could show it, with both denominators."""
    return [rate(hit).alias("naive_rate"), rate(F.when(eligible, hit.cast("double"))).alias("eligible_rate"), F.count("*").alias("n"), F.count_if(eligible).alias("n_eligible")]
