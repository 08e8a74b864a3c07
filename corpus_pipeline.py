"""From raw documents to training sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import _store
from lumenlake.llm._documents import with_plain_names
from lumenlake.llm.decontaminate import clean
from lumenlake.llm.langid import UNKNOWN, predict, train
from lumenlake.llm.line_dedup import dedup_lines
from lumenlake.llm.minhash import near_duplicates
from lumenlake.llm.packing import pack
from lumenlake.llm.queries import tokenizer_path


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns of documents that stages look at; others keep whatever names they have.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _keeps_columns(stage: Stage) -> Stage:
    """A stage that returns the columns it gets, in their order, with others of any names out of its way."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return with_plain_names(docs, KNOWN, lambda plain: stage(spark, plain, sf_dir).select(*plain.columns))

    return run


@_keeps_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, with that language where `lang` is null; the others go.

    Rejected are texts that the model can't assign: null, empty or without a letter, and every text if no row is labelled.
    Repeated rows fare alike; very long texts are read whole; an empty table stays empty; other columns, whatever their
    names, stay as they are.
    """
    found = predict(docs, train(docs)).filter(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", F.col("lang_pred").cast(docs.schema["lang"].dataType)))


@_keeps_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, nearly or exactly, go; so do documents that lose lines and have no word left.

    n_chars, where there is such a column, follows the text. Null and empty texts and null doc_ids stay; very long texts
    and lines are compared whole; repeated rows fare alike; an empty table stays empty; other columns, whatever their
    names, stay as they are.
    """
    left = dedup_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


@_keeps_columns
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id.

    Null, empty and blank texts and null doc_ids are in no group and stay; of rows that repeat a doc_id all stay or go;
    very long texts are compared whole; an empty table stays empty; all columns, whatever their names, stay as they are.
    """
    with _store.scope():
        gone = _store.result(near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "near")
    return docs.join(gone, "doc_id", "left_anti")


@_keeps_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a benchmark item go.

    Null and empty texts and null doc_ids stay; very long texts are aligned whole; repeated rows fare alike; an empty table
    or benchmark changes nothing; all columns, whatever their names, stay as they are.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences; null and empty texts are one token, very long ones many pieces,
    repeated rows are packed each."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Models, tokenizers and alignments are not for SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of documents. A stage's own tables, and its input, go as soon as its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with _store.scope():
            docs = _store.result(stage(spark, docs, sf_dir), name)
        if before is not None:
            _store.drop(before)
        before = docs
    return docs
