"""The six metrics of an explanation, on rows that hold answers, boxes and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import geometry as g
from lumenlake.functions import labels, rules

from . import quantiles, relational

#: What the summary says of each metric: its direction and the table it is from. Fixed values.
SUMMARY = {
    "descriptive_accuracy": ("higher_better", "descriptive_accuracy.csv"),
    "visual_sparsity_top5": ("higher_better", "visual_sparsity.csv"),
    "stability_answer_agreement": ("higher_better", "stability.csv"),
    "robustness_level1_answer_survival": ("higher_better", "robustness.csv"),
    "bounded_completeness": ("higher_better", "bounded_completeness.csv"),
    "efficiency_total_pipeline_1000hr": ("lower_better", "efficiency_summary.csv"),
}
NO_COUNT = "n/a -- aggregate runtime budget, not a per-sample classification"


# Descriptive accuracy
def answer_change(base: Column, base_confidence: Column, masked: Column, masked_confidence: Column) -> tuple[Column, Column]:
    """Whether a mask changes the answer, and how much confidence it takes."""
    return base != masked, base_confidence - masked_confidence


def unflipped(changed_1: Column, changed_2: Column) -> Column:
    """The answer changed under one mask and changed back under two."""
    return changed_1 & ~changed_2


# Stability
def agreement(runs: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Agreeing pairs over all pairs of runs, from counts instead of pairs; null for fewer than two runs."""
    counts = runs.groupBy(*keys, answer).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("runs"), F.sum(F.col("c") * (F.col("c") - 1)).alias("agreeing"))
    return totals.select(*keys, "runs", F.when(F.col("runs") > 1, F.col("agreeing") / (F.col("runs") * (F.col("runs") - 1))).alias("agreement_rate"))


def majority(runs: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """The most frequent answer, the first in alphabetical order of equals."""
    counts = runs.groupBy(*keys, answer).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.min_by(answer, F.struct(-F.col("c"), F.col(answer))).alias("majority_answer"))


def overlap(runs: DataFrame, keys: list[str], run: str = "run", box: str = "box", source: str | None = "source") -> DataFrame:
    """The mean IoU over pairs of runs' boxes; null with fewer than two, if any run has no box, or falls back to the grid.

    Runs of one key are few by design, so pairs are made within the row.
    """
    bad = F.col(box).isNull() if source is None else F.col(box).isNull() | (F.col(source) == "grid")
    held = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col(box).alias("b")))).alias("rs"), F.max(bad).alias("bad"), F.count("*").alias("runs"))
    pairs = F.flatten(F.transform("rs", lambda x: F.transform(F.filter("rs", lambda y: y.r > x.r), lambda y: g.iou(x.b, y.b))))
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)
    return held.select(*keys, F.when(~F.col("bad") & (F.col("runs") > 1), mean).alias("overlap_score"))


# Robustness
def robustness(base: DataFrame, variants: DataFrame, on: list[str]) -> DataFrame:
    """Each variant against its baseline: answer_changed, confidence_drop, object_box_iou (first boxes; null if one is missing), worker_lost.

    Both sides: on, answer, confidence, workers and objects (arrays of boxes); variants also perturbation.
    """
    b, v = base.alias("b"), variants.alias("v")
    joined = v.join(b, [F.col(f"v.{k}") == F.col(f"b.{k}") for k in on])
    sides = [F.struct(F.col(f"{t}.answer").alias("answer"), F.col(f"{t}.confidence").alias("confidence"), F.size(F.col(f"{t}.workers")).alias("workers"), F.get(F.col(f"{t}.objects"), F.lit(0)).alias("object")) for t in ("b", "v")]
    return joined.select(*(F.col(f"v.{k}") for k in on), "v.perturbation", *compared(*sides))


def compared(base: Column, variant: Column) -> list[Column]:
    """The same for two structs of answer, confidence, workers (how many) and object (the first one's box) in one row."""
    first = (base["object"], variant["object"])
    return [
        (base["answer"] != variant["answer"]).alias("answer_changed"),
        (base["confidence"] - variant["confidence"]).alias("confidence_drop"),
        F.when(first[0].isNotNull() & first[1].isNotNull(), g.iou(*first)).alias("object_box_iou"),
        ((base["workers"] > 0) & (variant["workers"] == 0)).alias("worker_lost"),
    ]


def excluded_level_2(rule: Column) -> Column:
    """Why a reworded prompt can't be scored, or null."""
    return F.when(rule == "rule_4", "rule_4_has_no_second_phrasing")


def patch_flip(base: Column, patched: Column) -> Column:
    return (base == "violation") & (patched == "compliant")


#: Whom the patch test is for, and how many of them.
PATCH_CLASS, PATCH_RULE, PATCH_ROWS = "ppe_violation", "rule_1", 20


def patch_candidates(rows: DataFrame, workers: Column, order: list[Column], n: int = PATCH_ROWS) -> DataFrame:
    """The first n samples of the class and rule that a hat can change and that have a worker to put it on."""
    return rows.filter((F.col("primary_class") == PATCH_CLASS) & (F.col("assigned_rule_id") == PATCH_RULE) & (workers > 0)).orderBy(*order).limit(n)


# Efficiency
def timing_stats(ms: str | Column) -> list[Column]:
    """n, mean, exact median, population deviation and maximum; null statistics without rows."""
    x = F.col(ms) if isinstance(ms, str) else ms
    return [F.count(x).alias("n"), F.avg(x).alias("mean_ms"), F.median(x).alias("median_ms"), F.stddev_pop(x).alias("std_ms"), F.max(x).alias("max_ms")]


def timings(rows: DataFrame, keys: list[str], ms: Column) -> DataFrame:
    """keys and the statistics of timing_stats, for groups of any size: the median is selected, not gathered in one task."""
    named = rows.select(*keys, ms.cast("double").alias("_ms"))
    plain = [c for c, name in zip(timing_stats("_ms"), ("n", "mean_ms", "median_ms", "std_ms", "max_ms"), strict=True) if name != "median_ms"]
    medians = quantiles.exact(named, keys, F.col("_ms"), {"median_ms": 0.5}).withColumnsRenamed({k: f"_{k}" for k in keys})
    stats = named.groupBy(*keys).agg(*plain)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return stats.join(medians, same, "left").select(*keys, "n", "mean_ms", "median_ms", "std_ms", "max_ms")


def reruns(n_regions: Column) -> Column:
    return F.when(n_regions >= 2, 2).otherwise(1)


def extrapolate(ms: Column, n: int) -> list[Column]:
    seconds = ms * n / 1000.0
    return [seconds.alias("seconds"), (seconds / 60).alias("minutes"), (seconds / 3600).alias("hours")]


def efficiency(predictions: DataFrame, regions: DataFrame, attribution: DataFrame, sampled: DataFrame, n_calibration: int = 15, n_runs: int = 3, n_full: int = 1000) -> DataFrame:
    """What each stage costs: the table efficiency_summary, four rows.

    predictions (image_id, assigned_rule_id, inference_ms) give the first stage, with regions (n_regions,
    top_region_source) the reruns of the second. The other two are timed on the first n_calibration samples by image_id
    and scaled to all: attribution (image_id, ms) without samples of the grid, which no phrase explains, and sampled
    reruns (image_id, ms).
    """
    keys = ["image_id", "assigned_rule_id"]
    merged = predictions.join(regions.select(*keys, "n_regions", "top_region_source"), keys)
    few = merged.select("image_id", "top_region_source", F.col("assigned_rule_id").alias("rule")).orderBy("image_id", "rule").limit(n_calibration)
    few = relational.first_by(few, ["image_id"], [F.col("rule")])
    ms, calls = F.col("inference_ms"), reruns(F.col("n_regions"))
    base = predictions.agg(F.avg(ms).alias("b_mean"), (F.sum(ms) / 1000).alias("b_total"), F.count("*").alias("n"))
    again = merged.agg(F.avg(calls.cast("double")).alias("a_calls"), F.avg(calls * ms).alias("a_mean"), (F.sum(calls * ms) / 1000).alias("a_total"))
    shown = few.filter("top_region_source != 'grid'").join(attribution, "image_id").agg(F.avg("ms").alias("s_mean"))
    runs = few.join(sampled, "image_id").agg(F.avg("ms").alias("r_mean"))
    one = base.join(again).join(shown).join(runs)  # a row each
    scaled = F.concat(F.lit(f"{n_calibration} calibration samples, scaled to "), F.col("n").cast("string"))

    def stage(day: int, name: str, calls: Column, call: Column, sample: Column, total: Column, n: Column) -> Column:
        _, minutes, hours = extrapolate(sample, n_full)
        return F.struct(
            F.lit(day).alias("day"), F.lit(name).alias("name"), calls.cast("double").alias("calls_per_sample"), call.alias("mean_ms_per_call"), sample.alias("mean_ms_per_sample"),
            total.alias("observed_total_seconds"), n.cast("string").alias("n_observed"), minutes.alias("extrapolated_1000_minutes"), hours.alias("extrapolated_1000_hours"),
        )

    c, sampled_ms = F.col, F.col("r_mean") * n_runs
    stages = [
        stage(3, "baseline_inference", F.lit(1), c("b_mean"), c("b_mean"), c("b_total"), c("n")),
        stage(5, "descriptive_accuracy_reruns", c("a_calls"), c("b_mean"), c("a_mean"), c("a_total"), c("n")),
        stage(6, "cross_attention_attribution", F.lit(1), c("s_mean"), c("s_mean"), c("s_mean") * c("n") / 1000, scaled),
        stage(7, "stability_sampled_reruns", F.lit(n_runs), c("r_mean"), sampled_ms, sampled_ms * c("n") / 1000, scaled),
    ]
    return one.select(F.inline(F.array(*stages)))


# Completeness
def completeness(accuracy: DataFrame, regions: DataFrame, samples: DataFrame, predictions: DataFrame, quality: DataFrame, masked: DataFrame) -> DataFrame:
    """Verdicts with what breaks them down, a row for each of accuracy that has its region, sample and prediction.

    accuracy and regions are joined on image_id and assigned_rule_id, the others on image_id. predictions are baseline rows
    as they are stored; masked (image_id, workers) has the workers that are found without the top region, where that is of
    the model: worker_lost_in_top1_mask is null elsewhere. quality (image_id, quality_of_info) may lack images.
    """
    keys = ["image_id", "assigned_rule_id"]
    before = rehydrate(predictions).select("image_id", (F.size("workers") > 0).alias("_had"))
    after = masked.select("image_id", (F.size("workers") > 0).alias("_has"))
    joined = accuracy.join(regions.select(*keys, "top_region_source"), keys).join(samples.select("image_id", "violated_rule_ids"), "image_id").join(before, "image_id")
    joined = joined.join(quality.select("image_id", "quality_of_info"), "image_id", "left").join(after, "image_id", "left")
    return joined.select(
        *keys,
        "primary_class",
        labels.verdict(F.col("top_region_source"), F.col("answer_changed_top1"), F.col("answer_changed_top2")).alias("verdict"),
        labels.is_multi(F.col("violated_rule_ids")).alias("is_multi_rule_violation"),
        "quality_of_info",
        "top_region_source",
        F.when(F.col("top_region_source") == "model", F.col("_had") & ~F.col("_has")).alias("worker_lost_in_top1_mask"),
    )


def rehydrate(predictions: DataFrame) -> DataFrame:
    """Stored predictions (image_id, answer, worker_boxes and object_boxes as JSON, confidence as text or number) as answers with boxes.

    A null or empty list cell is no boxes; a confidence that is no number is null.
    """
    held = lambda c: F.transform(F.coalesce(labels.boxes_json(F.col(c)), F.array().cast("array<array<double>>")), g.from_list)
    return predictions.select("image_id", "answer", held("worker_boxes").alias("workers"), held("object_boxes").alias("objects"), F.col("confidence").try_cast("double").alias("confidence"))


def summary(rows: DataFrame, values: dict[str, tuple[Column, Column]], hours: DataFrame, cls: str = "primary_class") -> DataFrame:
    """A row for each metric of SUMMARY: overall, by class, n and source.

    values: for each metric by sample its value and how many rows of the metric's table it stands for, 0 or null for
    none; rows whose value is null count in n, but not in means. All are read once. hours: one row with the pipeline's hours, which have neither classes nor n.
    """
    own = rows.select(cls, *(F.struct(v.cast("double").alias("v"), k.alias("k")).alias(m) for m, (v, k) in values.items()))

    def of(m: str) -> Column:
        value = F.when(F.col(m)["k"] > 0, F.col(m)["v"])
        by_class = [relational.rate(F.when(F.col(cls) == c, value)).alias(c) for c in rules.CLASSES]
        n = F.coalesce(F.sum(F.col(m)["k"]), F.lit(0)).cast("string")
        return F.struct(F.lit(m).alias("metric"), F.lit(SUMMARY[m][0]).alias("direction"), relational.rate(value).alias("overall"), *by_class, n.alias("n"), F.lit(SUMMARY[m][1]).alias("source_csv"))

    found = own.agg(F.array(*(of(m) for m in values)).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    m = "efficiency_total_pipeline_1000hr"
    none = [F.lit(None).cast("double").alias(c) for c in rules.CLASSES]
    total = hours.select(F.lit(m).alias("metric"), F.lit(SUMMARY[m][0]).alias("direction"), F.col("hours").alias("overall"), *none, F.lit(NO_COUNT).alias("n"), F.lit(SUMMARY[m][1]).alias("source_csv"))
    return found.unionByName(total)


def calibration(timings: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each key: timings that stand for all."""
    ranked = timings.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= limit).drop("_rn")
