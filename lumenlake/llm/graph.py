"""Connected components by least labels and pointer jumping, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the least node it reaches. Nodes without edges are not in it.

    Each round takes the least label among the neighbours and then the label of that label; labels only fall, and the
    rounds end when every edge joins equal labels. Hubs are aggregated before the shuffle; nothing goes to the driver
    but a count.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = _store.written(both.filter("a != b").distinct(), "edges")
    labels = _store.written(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("component")), "labels")
    while True:
        at = labels.select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        near = both.join(at, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"), F.max("theirs").alias("most"))
        step = labels.join(near, "node").select("node", F.least("component", "theirs").alias("component"), (F.greatest("component", "most") != F.least("component", "theirs")).cast("int").alias("open"))
        step = _store.written(step, "step")
        if not (step.agg(F.sum("open")).first()[0] or 0):
            return step.select("node", "component")
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = _store.written(step.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "labels")
