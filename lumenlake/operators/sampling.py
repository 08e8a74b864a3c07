"""Balanced, deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import labels, rules


def classify(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """rows with violated_rules and primary_class; flags: for each rule whether it is violated."""
    found = rows.withColumn("violated_rules", labels.violated(flags))
    return found.withColumn("primary_class", labels.primary_class(F.col("violated_rules")))


def random_order(key: Column, seed: int) -> Column:
    """The same order in every engine: by a digest of key and seed."""
    return F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))


def balanced_sample(rows: DataFrame, per_class: int, seed: int, order: Column, key: str = "image_id", pool: int = 10) -> DataFrame:
    """per_class rows of each primary_class, drawn from its first pool * per_class rows by order, each with a rule.

    rows: key, primary_class, violated_rules. Both ranks keep a bounded number of rows of a class (Spark limits windows by
    rank before the shuffle), so a class may be as large as the table.
    """
    by_class = Window.partitionBy("primary_class")
    first = rows.withColumn("_pos", F.row_number().over(by_class.orderBy(order, key))).filter(F.col("_pos") <= pool * per_class)
    drawn = first.withColumn("_rn", F.row_number().over(by_class.orderBy(random_order(F.col(key), seed), key))).filter(F.col("_rn") <= per_class)
    return drawn.withColumn("assigned_rule_id", labels.assigned_rule(F.col("primary_class"), F.col("violated_rules"), F.col("_rn") - 1)).drop("_pos", "_rn")


def class_counts(rows: DataFrame) -> DataFrame:
    """How many rows each class has, those without any too."""
    names = rows.sparkSession.createDataFrame([(c,) for c in rules.CLASSES], "primary_class string")
    counted = rows.groupBy("primary_class").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counted, "primary_class", "left").select("primary_class", F.coalesce("n", F.lit(0)).alias("n"))


def underfilled(rows: DataFrame, target: int) -> DataFrame:
    return class_counts(rows).filter(F.col("n") < target)


def budget(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key: what is drawn as figures."""
    if n < 0:
        raise ValueError("n must not be negative")
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")
