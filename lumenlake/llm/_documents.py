"""Documents told apart where they repeat a doc_id."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, own and text of docs (doc_id, text): own is 0, or a digest of the text for rows whose doc_id is repeated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    again = _store.result(again.select("doc_id", F.lit(True).alias("_again")), "again")
    return rows.join(again, "doc_id", "left").select("doc_id", F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("own"), "text")


def with_plain_names(docs: DataFrame, used: Collection[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f of docs, whose columns but those used go under plain names meanwhile, so that any name is possible, also with dots."""
    plain = {f"other_{i}": c for i, c in enumerate(docs.columns) if c not in used}
    named = {c: p for p, c in plain.items()}
    found = f(docs.toDF(*(named.get(c, c) for c in docs.columns)))
    return found.toDF(*(plain.get(c, c) for c in found.columns))
