"""Bounded pools of a stream's first rows by class, as a stateful operator.

A class's pool takes rows until it has `cap` of them and ignores what comes later. State is the list of a pool's keys, at most
`cap` long, so it is bounded whatever the stream. Inside a micro-batch rows come in the given order; of each class no more
than the pool's room is ever held.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

#: What keeps list state; the default store has none.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Pool(StatefulProcessor):
    def __init__(self, key: str, order: str, cap: int, columns: list[str]):
        self.key, self.order, self.cap, self.columns = key, order, cap, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "key string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        there = sum(1 for _ in self.held.get()) if self.held.exists() else 0
        room = self.cap - there
        if room <= 0:  # rows of a full pool are not looked at
            return
        first: list[tuple] = []
        for b in rows:
            at = list(zip(b[self.order], b[self.key], b[self.columns].itertuples(index=False, name=None), strict=True))
            first = heapq.nsmallest(room, [*first, *at], key=lambda r: r[:2])
        if first:
            self.held.appendList([(str(r[1]),) for r in first])
            out = pd.DataFrame([r[2] for r in first], columns=self.columns)
            out["place"] = range(there + 1, there + len(out) + 1)
            yield out

    def close(self) -> None:
        pass


def pools(stream: DataFrame, by: str, key: str, order: str, cap: int) -> DataFrame:
    """The rows of stream that are the first `cap` of their class, each as it comes, with their place (from 1) in the pool.

    by: the class; order: what rows of one micro-batch are ordered by, equal ones by key. Rows of a null class make a
    class of their own.
    """
    if cap < 1:
        raise ValueError("cap must be at least 1")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a task's rows no more of each class than a pool takes, so that a class of most rows is not one task's."""
        held = None
        for b in batches:
            both = b if held is None else pd.concat([held, b])
            held = both.sort_values([order, key], kind="stable").groupby(by, dropna=False).head(cap)
        if held is not None:
            yield held

    few = stream.mapInPandas(first, stream.schema)
    return few.groupBy(by).transformWithStateInPandas(Pool(key, order, cap, stream.columns), outputStructType=_schema(stream), outputMode="Append", timeMode="None")


def _schema(stream: DataFrame) -> StructType:
    return StructType([*stream.schema.fields, StructField("place", IntegerType())])


def _held(spark: SparkSession, schema: StructType, path: str, by: str) -> dict[Any, int]:
    """How many rows of each class have been written: a row a class."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    return {r[0]: r["count"] for r in spark.read.schema(schema).parquet(path).groupBy(by).count().collect()}


def fill(stream: DataFrame, classes: list[str], by: str, key: str, order: str, cap: int, path: str, checkpoint: str, wait: Callable[[StreamingQuery], bool] | None = None) -> DataFrame:
    """Run a stream into pools at path until all classes are full or its data is at an end; returns the pools.

    Each micro-batch is a folder of its own, written anew if it is repeated, so a restart from the checkpoint adds no row
    twice and goes on with the pools as they were. wait, if given, says after each look whether to stop early.
    """
    spark, schema = stream.sparkSession, _schema(stream)
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    full = lambda held: all(held.get(c, 0) >= cap for c in classes)
    done = [full(_held(spark, schema, path, by))]

    def keep(batch: DataFrame, number: int) -> None:
        if not done[0]:  # what comes after all pools are full is not written: it has no rows
            batch.write.mode("overwrite").parquet(f"{path}/batch={number:08}")
            done[0] = full(_held(spark, schema, path, by))

    try:
        if not done[0]:
            query = pools(stream, by, key, order, cap).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            stopped = False
            while query.isActive:
                if done[0] or (wait and wait(query)):
                    stopped = True
                    query.stop()  # a micro-batch that this cuts off is done again after a restart
                time.sleep(0.05)
            if not stopped and query.exception() is not None:
                raise query.exception()
    finally:
        spark.conf.set(STORE[0], before)
    written = _held(spark, schema, path, by)
    return spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)
