"""Places in a total order of all rows, without a window over the whole table.

Rows are dealt to ranges of the order and sorted inside each. A row's place is what the ranges before it hold, which takes one
count a range, and its own number in its range. No task gets more than its range, however large the table or a group is.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: monotonically_increasing_id keeps the row's number in its partition in so many bits.
_ROW_BITS = 33


def in_ranges(rows: DataFrame, order: list[Column], column: str = "_at") -> DataFrame:
    """rows in `spark.sql.shuffle.partitions` ranges of order, with column as range and number in it.

    Which rows make a range is found by sampling, so write the result before it is used twice; what is sampled is read twice,
    so pass rows that are cheap to read. Rows that are equal in all of order stay in one range: end it with a key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(column, F.monotonically_increasing_id())


def range_of(column: str = "_at") -> Column:
    return F.shiftright(column, _ROW_BITS).cast("int")


def starts(table: DataFrame, column: str = "_at") -> dict[int, int]:
    """For each range of a table that in_ranges has made how many rows come before it: one number a range reaches the driver."""
    held = sorted((r["k"], r["n"]) for r in table.groupBy(range_of(column).alias("k")).agg(F.count("*").alias("n")).collect())
    return dict(zip((k for k, _ in held), accumulate((n for _, n in held), initial=0), strict=False))


def placed(table: DataFrame, column: str = "_at", name: str = "place") -> DataFrame:
    """table with each row's place in the order, from 0, instead of column."""
    before = table.sparkSession.createDataFrame(list(starts(table, column).items()), "_range int, _before long")
    number = F.col(column).bitwiseAND((1 << _ROW_BITS) - 1)
    found = table.withColumn("_range", range_of(column)).join(F.broadcast(before), "_range")  # a row for each range
    return found.withColumn(name, F.col("_before") + number).drop("_range", "_before", column)
