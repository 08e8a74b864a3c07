"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import threading
import time
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_open = threading.local()
_where: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on one machine, where it is unset, a folder of the warehouse."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return at.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it goes at the end of the scope around, or else when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lumenlake/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # also after the session has been stopped
    scopes = getattr(_open, "scopes", None)
    if scopes:
        scopes[-1].append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read back."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _where[table] = path
    return table


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
    if paths:
        free_shuffles(spark)


def drop(table: DataFrame) -> None:
    """Delete what `written` or `result` has written as table."""
    _delete(table.sparkSession, [_where.pop(table)])


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside go at its end, but for those that `result` writes; shuffle files of its jobs go too.

    A DataFrame that reads such a table must not leave the scope.
    """
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    _open.scopes.append([])
    try:
        yield
    finally:
        mine = _open.scopes.pop()
        if mine:
            _delete(mine[0][0], [path for _, path in mine])


def result(df: DataFrame, name: str) -> DataFrame:
    """As `written`, for what outlives the scope it is called in: it belongs to the scope around that one."""
    scopes = getattr(_open, "scopes", None) or []
    inner = [scopes.pop()] if scopes else []
    try:
        return written(df, name)
    finally:
        scopes.extend(inner)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's garbage is collected, which a large heap puts off: do it now.

    The first collection lets go of the plan, the next one of the shuffles that only the plan held.
    """
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def in_rounds(spark: SparkSession, make: Callable[[int], DataFrame], rounds: int, name: str) -> DataFrame:
    """As `written`, for make(0), make(1) and so on together. A round's own tables and shuffle files go before the next, so that disk
    holds one round's only."""
    path = new_path(spark, name)
    for i in range(rounds):
        with scope():
            df = make(i)
            schema = df.schema
            df.write.mode("append").parquet(path)
            del df
        free_shuffles(spark)
    table = spark.read.schema(schema).parquet(path)
    _where[table] = path
    return table


#: Longs in a table of bits.
WORDS = 1 << 16


def among(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test of a hash: false only if it is not in hashes (one column of longs). It lets others pass, the more the fuller its table of
    fixed size is, so a join must follow; what it holds back need not be shuffled for that. The table is a subquery's value: as a
    literal it would be in every plan that the driver keeps."""
    h = F.col(hashes.columns[0])
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    word = lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(WORDS - 1)
    some = hashes.groupBy(word(h).alias("at")).agg(F.bit_or(bit(h)).alias("bits"))
    every = some.union(hashes.sparkSession.range(0, WORDS, 1, 1).select("id", F.lit(0).cast("long"))).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    table = written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits")), "bits")
    held = table.scalar()
    return lambda x: F.get(held, word(x).cast("int")).bitwiseAND(bit(x)) != 0


def lookup(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined (inner or left) with right, which is unique by keys and holds in `count` how many rows of left each key has.

    Keys with more than 1/share of all counted rows, of which there are fewer than `share`, are joined by broadcast,
    so that no task gets all rows of one key; the rest is an ordinary join. Both sides are read twice: pass written tables.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    most = max(total // share, 1000)
    hot = right.filter(F.col(count) > most)
    cold = right.filter(F.col(count) <= most)
    names = hot.select(*keys, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(names), keys, "left")
    one = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), keys)
    two = marked.filter("_hot is null").drop("_hot").join(cold, keys, how)
    return one.unionByName(two)
