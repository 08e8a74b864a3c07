"""Attention rollout: how much of each token reaches each other one through all layers.

A layer's heads are averaged, half of each token's weight stays with itself, rows sum to one, and layers are chained by matrix
products. Matrices are dealt in square blocks: a product joins blocks on the side they share and adds up what meets in a
block, so no task holds a matrix. A written table stands between layers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from lumenlake.sources import tables

BLOCK = 128


def _side(k: int, size: int, block: int) -> int:
    """How many rows the k-th block has."""
    return min(block, size - k * block)


def _cells(matrix: np.ndarray) -> pa.Array:
    return pa.array([matrix.ravel()], pa.list_(pa.float64()))


def _layer(size: int, block: int, keys: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """A stripe of a layer's matrix, a block of rows high, as blocks."""
        i = key[keys + 1].as_py()
        total, seen = np.zeros((_side(i, size, block), size)), np.zeros(_side(i, size, block))
        at = rows["row"].to_numpy() - i * block
        for r, w in zip(at, rows["weights"], strict=True):
            total[r] += np.asarray(w.as_py(), float)
            seen[r] += 1
        mixed = total / np.maximum(seen, 1)[:, None]
        mixed[np.arange(len(mixed)), i * block + np.arange(len(mixed))] += 1  # as much as all others of the row together
        mixed /= np.maximum(mixed.sum(axis=1), 1e-300)[:, None]
        parts = [mixed[:, k : k + block] for k in range(0, size, block)]
        names = [f.name for f in rows.schema][:keys]
        out = {n: pa.array([v.as_py()] * len(parts), v.type) for n, v in zip(names, key, strict=False)}
        return pa.table(out | {"layer": pa.array([key[keys].as_py()] * len(parts), pa.int32()), "i": pa.array([i] * len(parts), pa.int32()), "j": pa.array(range(len(parts)), pa.int32()), "cells": pa.chunked_array([_cells(p) for p in parts])})

    return run


def _product(size: int, block: int, keys: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = (key[keys + n].as_py() for n in (0, 1))
        high, wide = _side(i, size, block), _side(j, size, block)
        total = np.zeros((high, wide))
        for a, b in zip(rows["a"], rows["b"], strict=True):
            total += np.asarray(a.as_py()).reshape(high, -1) @ np.asarray(b.as_py()).reshape(-1, wide)
        out = {f.name: pa.array([v.as_py()], v.type) for f, v in zip(rows.schema, key, strict=False)}
        return pa.table(out | {"cells": _cells(total)})

    return run


def _whole(size: int, block: int, keys: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Rows of a stripe from its blocks."""
        i = key[keys].as_py()
        high = _side(i, size, block)
        parts = sorted(zip(rows["j"].to_pylist(), rows["cells"], strict=True), key=lambda x: x[0])
        stripe = np.concatenate([np.asarray(c.as_py()).reshape(high, -1) for _, c in parts], axis=1)
        out = {f.name: pa.array([v.as_py()] * high, v.type) for f, v in zip(list(rows.schema)[:keys], key, strict=False)}
        return pa.table(out | {"row": pa.array(range(i * block, i * block + high), pa.int32()), "weights": pa.array(list(stripe), pa.list_(pa.float64()))})

    return run


def rollout(attention: DataFrame, keys: list[str], size: int, block: int = BLOCK) -> DataFrame:
    """keys, row and weights (size numbers that sum to 1): what a row's token has of each token of the input.

    attention: keys, layer (from the input up), row and weights (size numbers, not negative), one row for each head, which
    are averaged. A row that a layer lacks passes its token on as it is. Layers are few: their numbers reach the driver.
    """
    held = attention.select(*keys, F.col("layer").cast("int").alias("layer"), F.col("row").cast("int").alias("row"), F.col("weights").cast("array<double>").alias("weights"))
    layers = [r[0] for r in held.select("layer").distinct().orderBy("layer").collect()]
    number = lambda *names: [StructField(n, IntegerType()) for n in names]
    own, cells = [f for f in held.schema if f.name in keys], StructField("cells", ArrayType(DoubleType()))
    # Every layer has all stripes, also those without a row.
    stripes = held.select(*keys).distinct().withColumn("layer", F.explode(F.array(*map(F.lit, layers or [0])))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(-(-size // block) - 1))))
    wide = stripes.select(*keys, "layer", "i", F.lit(None).cast("int").alias("row"), F.lit(None).cast("array<double>").alias("weights"))
    every = held.withColumn("i", F.floor(F.col("row") / block).cast("int")).select(*keys, "layer", "i", "row", "weights").unionByName(wide)
    make = _layer(size, block, len(keys))
    dealt = every.groupBy(*keys, "layer", "i").applyInArrow(lambda key, rows: make(key, rows.filter(rows["row"].is_valid())), StructType([*own, *number("layer", "i", "j"), cells]))
    dealt = tables.stored(dealt, "layers")
    found = dealt.filter(F.col("layer") == (layers[0] if layers else 0)).select(*keys, "i", "j", "cells")
    for layer in layers[1:]:
        a = dealt.filter(F.col("layer") == layer).select(*keys, "i", F.col("j").alias("k"), F.col("cells").alias("a"))
        b = found.select(*keys, F.col("i").alias("k"), "j", F.col("cells").alias("b"))
        joined = a.join(b, [*keys, "k"]).select(*keys, "i", "j", "a", "b")
        found = tables.stored(joined.groupBy(*keys, "i", "j").applyInArrow(_product(size, block, len(keys)), StructType([*own, *number("i", "j"), cells])), "product")
    out = StructType([*own, *number("row"), StructField("weights", ArrayType(DoubleType()))])
    return found.groupBy(*keys, "i").applyInArrow(_whole(size, block, len(keys)), out)
