"""Answers from boxes: presence rules and the proximity rule, in the row or over exploded boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import geometry as g
from lumenlake.functions import rules


def presence(workers: Column, objects: Column, threshold: Column) -> Column:
    """`compliant` if every worker has a close object; without workers, if there is any object."""
    alone = F.when(F.size(objects) > 0, "compliant").otherwise("violation")
    return F.when(F.size(workers) == 0, alone).when(g.covered(workers, objects, threshold), "compliant").otherwise("violation")


def proximity(workers: Column, machines: Column, threshold: Column) -> Column:
    return F.when(g.any_close(workers, machines, threshold), "hazard").otherwise("safe")


def answer(rule: Column, workers: Column, objects: Column, width: Column, height: Column) -> Column:
    """The answer to a rule; other rules raise."""
    limit = g.threshold(rules.lookup(rule, rules.THRESHOLD), width, height)
    return F.when(rules.known(rule, rules.RULES, "rule") == "rule_4", proximity(workers, objects, limit)).otherwise(presence(workers, objects, limit))


def phrases(rule: Column, phrasing: int = 0) -> Column:
    """The two phrases that an answer looks for, persons first. A proximity rule has one pair and ignores the phrasing."""
    presence_rule = F.when(rules.known(rule, rules.RULES, "rule") != "rule_4", rule)
    own = F.when(rule == "rule_4", F.lit(rules.PROXIMITY_PAIR[1])).otherwise(rules.grounding_query(presence_rule, phrasing))
    return F.array(F.lit(rules.PERSON), own)


def downstream_boxes(workers: Column, objects: Column) -> Column:
    return F.concat(workers, objects)


def run_confidence(worker: Column, thing: Column) -> Column:
    """The mean of both detections' confidences; null if one is."""
    return (worker + thing) / 2


def detection_confidence(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows keys, step, beam, logits (array): the mean over steps of the mean over beams of the largest softmax share."""
    top = F.array_max("logits")
    share = F.lit(1.0) / F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    per_step = steps.select(*keys, "step", share.alias("p")).groupBy(*keys, "step").agg(F.avg("p").alias("p"))
    return per_step.groupBy(*keys).agg(F.avg("p").alias("confidence"))


def coverage_exploded(samples: DataFrame, boxes: DataFrame, threshold: float) -> DataFrame:
    """sample_id and answer of presence over one row per box (sample_id, role, ord, x0..y1): a join instead of nested arrays.

    A worker without a close object makes a violation; samples without boxes keep their row. The join is on sample_id, with
    closeness as its condition, so it stays within a sample.
    """
    at = lambda t: g.box(*(F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")))
    workers, objects = boxes.filter("role = 'worker'").alias("w"), boxes.filter("role = 'object'").alias("o")
    bare = workers.join(objects, (F.col("w.sample_id") == F.col("o.sample_id")) & g.close(at("w"), at("o"), threshold), "left_anti")
    missing = bare.groupBy(F.col("w.sample_id").alias("sample_id")).agg(F.count("*").alias("bare"))
    held = boxes.groupBy("sample_id").agg(F.count_if(F.col("role") == "worker").alias("workers"), F.count_if(F.col("role") == "object").alias("objects"))
    joined = samples.select("sample_id").join(held, "sample_id", "left").join(missing, "sample_id", "left")
    alone = F.when(F.coalesce("objects", F.lit(0)) > 0, "compliant").otherwise("violation")
    verdict = F.when(F.coalesce("workers", F.lit(0)) == 0, alone).when(F.coalesce("bare", F.lit(0)) == 0, "compliant").otherwise("violation")
    return joined.select("sample_id", verdict.alias("answer"))


def in_row(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """samples with arrays workers and objects in their order; empty ones where a sample has no box."""
    held = F.struct("ord", g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("b"))
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, held))), lambda s: s.b)
    arrays = boxes.groupBy("sample_id").agg(of("worker").alias("workers"), of("object").alias("objects"))
    none = F.array().cast(f"array<{g.BOX}>")
    return samples.join(arrays, "sample_id", "left").withColumns({c: F.coalesce(c, none) for c in ("workers", "objects")})
