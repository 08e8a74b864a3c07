"""Invariants of geometry, answers, metrics and tables on small inputs."""

import math
import os
import random
import sys
import uuid

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumenlake.functions import geometry as g
from lumenlake.functions import heatmaps as h
from lumenlake.functions import labels, rules
from lumenlake.operators import attribution, decide, images, inference, metrics, relational, sampling
from lumenlake.sources import tables

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(*values):
    return F.array(*(g.box(*map(F.lit, map(float, v))) for v in values)) if values else F.array().cast(f"array<{BOX}>")


def box(*v):
    return g.box(*(F.lit(float(x)) for x in v))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _cells(b):
    """The unit cells of a box with whole corners."""
    return {(x, y) for x in range(int(b[0]), int(b[2])) for y in range(int(b[1]), int(b[3]))}


@pytest.mark.parametrize("seed", range(12))
def test_iou_counts_cells(spark, seed):
    rng = random.Random(seed)
    corner = lambda: sorted(rng.sample(range(13), 2)) if rng.random() < 0.9 else [rng.randrange(13)] * 2
    pairs = []
    for _ in range(12):
        (ax0, ax1), (ay0, ay1), (bx0, bx1), (by0, by1) = corner(), corner(), corner(), corner()
        pairs.append(((ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1)))
    pairs.append((pairs[0][0], pairs[0][0]))
    pairs.append(((7, 6, 2, 3), pairs[1][1]))  # inverted: no area
    got = spark.createDataFrame([(k, tuple(map(float, a)), tuple(map(float, b))) for k, (a, b) in enumerate(pairs)], f"k int, a {BOX}, b {BOX}").select("k", g.iou(F.col("a"), F.col("b")).alias("x"), g.iou(F.col("b"), F.col("a")).alias("y")).collect()
    for r in got:
        a, b = map(_cells, pairs[r.k])
        want = len(a & b) / len(a | b) if a | b else 0.0
        assert r.x == pytest.approx(want) and r.y == pytest.approx(want)


def test_closeness_includes_the_threshold(spark):
    assert one(spark, g.close(box(0, 0, 10, 10), box(12, 0, 20, 10), 2.0))
    assert not one(spark, g.close(box(0, 0, 10, 10), box(100, 100, 110, 110), 5.0))
    assert one(spark, g.close(box(0, 0, 10, 10), box(10, 0, 20, 10)))  # edges touch


@pytest.mark.parametrize(("workers", "objects", "expected"), [([(0, 0, 9, 9), (50, 0, 59, 9)], [(0, 0, 5, 5), (51, 0, 55, 5)], True), ([(0, 0, 9, 9), (50, 0, 59, 9)], [(0, 0, 5, 5)], False), ([(0, 0, 9, 9)], [], False), ([], [], True)])
def test_coverage(spark, workers, objects, expected):
    assert one(spark, g.covered(boxes(*workers), boxes(*objects), 5.0)) is expected


@pytest.mark.parametrize(("width", "height"), [(130.0, 52.0), (36.0, 90.0)])
def test_grid_covers_the_frame_once(spark, width, height):
    cells = [tuple(c) for c in one(spark, g.grid(F.lit(width), F.lit(height)))]
    assert len(set(cells)) == 16 and sum((c[2] - c[0]) * (c[3] - c[1]) for c in cells) == pytest.approx(width * height)
    assert cells == sorted(cells, key=lambda c: (c[1], c[0])) and min(c[0] for c in cells) == 0 and max(c[3] for c in cells) == height
    fallback = one(spark, g.rank_regions(boxes(), F.array().cast("array<string>"), F.lit(width), F.lit(height)))
    assert [tuple(r.box) for r in fallback] == cells and {r.source for r in fallback} == {"grid"}


def test_ranking_is_by_area_and_stable(spark):
    rng = random.Random(6)
    held = [(x, y, x + rng.choice([3, 7, 20]), y + rng.choice([2, 9])) for x, y in ((rng.randrange(50), rng.randrange(50)) for _ in range(14))]
    names = [f"n{k}" for k in range(14)]
    ranked = one(spark, g.rank_regions(boxes(*held), F.array(*map(F.lit, names)), F.lit(90.0), F.lit(70.0)))
    area = lambda k: (held[k][2] - held[k][0]) * (held[k][3] - held[k][1])
    assert [r.label for r in ranked] == [names[k] for k in sorted(range(14), key=lambda k: -area(k))] and {r.source for r in ranked} == {"model"}


def test_round_and_clip(spark):
    assert tuple(one(spark, g.to_frame(box(-3.5, 2.5, 8.5, 700), F.lit(640.0), F.lit(480.0)))) == (0, 2, 8, 480)
    assert one(spark, g.to_frame(box(700, 0, 800, 10), F.lit(640.0), F.lit(480.0))) is None


def test_classes_and_rules(spark):
    def found(*flags):
        row = spark.range(1).select(labels.violated({r: F.lit(f) for r, f in zip(rules.RULES, flags, strict=True)}).alias("v"))
        row = row.select("v", labels.primary_class(F.col("v")).alias("c"))
        return row.select("v", "c", labels.assigned_rule(F.col("c"), F.col("v"), F.lit(5)).alias("r")).first()

    assert found(False, False, False, False).c == "compliant" and found(False, False, False, False).r == "rule_2"
    assert found(True, False, False, True).c == "ppe_violation" and found(True, False, False, True).v == ["rule_1", "rule_4"]
    assert found(False, True, True, False).r == "rule_2" and found(False, False, True, False).c == "fall_hazard"
    assert found(False, False, False, True).c == "struck_by_risk"


def test_answers(spark):
    ask = lambda rule, w, o: one(spark, decide.answer(F.lit(rule), boxes(*w), boxes(*o), F.lit(100.0), F.lit(50.0)))
    assert ask("rule_1", [], [(0, 0, 1, 1)]) == "compliant" and ask("rule_1", [], []) == "violation"
    assert ask("rule_1", [(0, 0, 1, 1)], [(9, 0, 10, 1)]) == "compliant" and ask("rule_1", [(0, 0, 1, 1)], [(9.1, 0, 10, 1)]) == "violation"
    assert ask("rule_4", [], [(0, 0, 1, 1)]) == "safe" and ask("rule_4", [(0, 0, 1, 1)], [(6, 0, 7, 1)]) == "hazard"
    with pytest.raises(Exception, match="unknown rule"):
        ask("rule_9", [], [])


def test_exploded_and_in_row_coverage_agree(spark):
    rows = [(i % 7, "worker" if i % 3 else "object", i, float(i * 37 % 100), float(i * 11 % 60), float(i * 37 % 100 + 10), float(i * 11 % 60 + 10)) for i in range(60)]
    samples = spark.range(9).withColumnRenamed("id", "sample_id")
    held = spark.createDataFrame(rows, "sample_id long, role string, ord int, x0 double, y0 double, x1 double, y1 double")
    a = {tuple(r) for r in decide.coverage_exploded(samples, held, 15.0).select("sample_id", "answer").collect()}
    b = {tuple(r) for r in decide.in_row(samples, held).select("sample_id", decide.presence(F.col("workers"), F.col("objects"), F.lit(15.0))).collect()}
    assert a == b and len(a) == 9


def test_sparsity(spark):
    rng = random.Random(3)
    arr = lambda v: F.array(*(F.lit(float(x)) for x in v))
    cells = [rng.choice([0, 1, 3, 8, 13]) / 13 for _ in range(23)]
    for k in (1, 6, 23, 40):
        assert one(spark, h.top_mass_ratio(arr(cells), k)) == pytest.approx(sum(sorted(cells)[-k:]) / sum(cells))
    assert one(spark, h.top_mass_ratio(arr([0] * 5), 2)) is None
    assert one(spark, h.count_above(arr(cells))) == sum(x >= 0.5 for x in cells) and one(spark, h.count_above(arr([0.49, 0.5, math.nan]))) == 1
    assert one(spark, h.min_max(arr([-1, 7, 3]))) == [0, 1, 0.5] and one(spark, h.min_max(arr([6, 6, 6]))) == [0, 0, 0]
    # the first entry is no cell: however extreme, it does not change the map
    assert one(spark, h.normalised(arr([900, *cells]), 23)) == one(spark, h.min_max(arr(cells)))
    with pytest.raises(ValueError):
        h.top_mass_ratio(F.lit(None), 0)


def test_heat_maps_are_means(spark):
    rng = np.random.default_rng(4)
    steps = {s: rng.random((3, 12)) for s in range(4)}
    rows = [("a", s, w.tolist()) for s, ws in steps.items() for w in ws]
    targets = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {r.k: r for r in attribution.heat_maps(targets, spark.createDataFrame(rows, "k string, step int, weights array<double>"), ["k"], 9).collect()}
    mean = np.mean([w.mean(axis=0) for w in steps.values()], axis=0)[1:10]
    assert got["a"].heatmap == pytest.approx((mean - mean.min()) / (mean.max() - mean.min())) and got["a"].n_generated_tokens == 4
    assert got["b"].heatmap == [0.0] * 9 and got["b"].n_generated_tokens == 0


def test_stability(spark):
    rng = random.Random(1)
    runs = {f"s{k}": [rng.choice(["yes", "no", "unsure"]) for _ in range(rng.randint(1, 7))] for k in range(20)}
    df = spark.createDataFrame([(k, i, x) for k, xs in runs.items() for i, x in enumerate(xs)], "k string, run int, answer string")
    got = {r.k: r.agreement_rate for r in metrics.agreement(df, ["k"]).collect()}
    most = {r.k: r.majority_answer for r in metrics.majority(df, ["k"]).collect()}
    for k, xs in runs.items():
        pairs = [x == y for i, x in enumerate(xs) for y in xs[:i]]
        assert got[k] == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)
        assert most[k] == min(sorted(set(xs)), key=lambda x: -xs.count(x))
    unit = lambda x: (float(x), 0.0, x + 4.0, 3.0)
    regions = [("a", r, unit(0), "model") for r in (1, 2, 3)] + [("b", 1, unit(0), "model"), ("b", 2, unit(9), "model"), ("c", 1, unit(0), "model"), ("c", 2, unit(0), "grid"), ("d", 1, unit(0), "model"), ("d", 2, unit(2), "model")]
    found = metrics.overlap(spark.createDataFrame(regions, f"k string, run int, box {BOX}, source string"), ["k"])
    assert {r.k: r.overlap_score and round(r.overlap_score, 9) for r in found.collect()} == {"a": 1, "b": 0, "c": None, "d": round(1 / 3, 9)}


def test_robustness_and_verdict(spark):
    schema = f"k int, answer string, confidence double, workers array<{BOX}>, objects array<{BOX}>"
    unit = (0.0, 0.0, 1.0, 1.0)
    base = spark.createDataFrame([(1, "compliant", 0.9, [unit], [unit])], schema)
    other = spark.createDataFrame([(1, "violation", 0.6, [], [], "blur"), (1, "compliant", 0.9, [unit], [unit], "none")], schema + ", perturbation string")
    got = {r.perturbation: r for r in metrics.robustness(base, other, ["k"]).collect()}
    assert got["blur"].answer_changed and got["blur"].worker_lost and got["blur"].object_box_iou is None and got["blur"].confidence_drop == pytest.approx(0.3)
    assert not got["none"].answer_changed and not got["none"].worker_lost and got["none"].object_box_iou == 1
    v = lambda s, a, b: one(spark, labels.verdict(F.lit(s), F.lit(a), F.lit(b)))
    assert [v("grid", True, True), v("model", False, False), v("model", True, False), v("model", False, True)] == ["no_usable_explanation", "explanation_weak", "explanation_supported", "explanation_supported"]


def test_timings(spark):
    values = np.random.default_rng(8).gamma(2, 40, 37)
    rows = spark.createDataFrame([(float(v),) for v in values], "ms double")
    r = rows.agg(*metrics.timing_stats("ms")).first()
    assert r.n == 37 and (r.mean_ms, r.median_ms, r.std_ms, r.max_ms) == pytest.approx((values.mean(), np.median(values), values.std(), values.max()))
    assert rows.filter("false").agg(*metrics.timing_stats("ms")).first().mean_ms is None
    assert tuple(spark.range(1).select(*metrics.extrapolate(F.lit(72.0), 250)).first()) == pytest.approx((18, 0.3, 0.005))


def test_summary_of_six_metrics(spark):
    rows = spark.createDataFrame([("compliant", True, 0.5), ("fall_hazard", False, None), ("compliant", False, 1.0)], "primary_class string, hit boolean, v double")
    own = {m: (F.col("hit") if m == "descriptive_accuracy" else F.col("v"), F.lit(4 if "robust" in m else 1)) for m in list(metrics.SUMMARY)[:5]}
    got = {r.metric: r for r in metrics.summary(rows, own, spark.createDataFrame([(2.5,)], "hours double")).collect()}
    assert list(got) == list(metrics.SUMMARY)
    first, sparse, robust, hours = (got[m] for m in ("descriptive_accuracy", "visual_sparsity_top5", "robustness_level1_answer_survival", "efficiency_total_pipeline_1000hr"))
    assert (first.overall, first.compliant, first.fall_hazard, first.struck_by_risk, first.n) == (pytest.approx(1 / 3), 0.5, 0.0, None, "3")
    assert (sparse.overall, sparse.fall_hazard, sparse.n) == (0.75, None, "3") and robust.n == "12"  # a null score is a row too
    assert (hours.overall, hours.compliant, hours.direction) == (2.5, None, "lower_better") and hours.n.startswith("n/a")


def test_stored_answers_come_back(spark):
    rows = spark.createDataFrame([("1", "safe", "[[1, 2, 3, 4.5]]", "[]", "0.25"), ("2", "hazard", None, "", "none")], "image_id string, answer string, worker_boxes string, object_boxes string, confidence string")
    a, b = metrics.rehydrate(rows).orderBy("image_id").collect()
    assert [tuple(x) for x in a.workers] == [(1, 2, 3, 4.5)] and a.objects == [] and a.confidence == 0.25
    assert b.workers == [] and b.objects == [] and b.confidence is None


def test_phrases(spark):
    both = lambda rule, k: one(spark, decide.phrases(F.lit(rule), k))
    for rule, own in rules.PHRASES.items():
        assert [both(rule, k) for k in (0, 1)] == [["worker", own[0]], ["worker", own[1]]]
    assert both("rule_4", 0) == both("rule_4", 1) == list(rules.PROXIMITY_PAIR)  # it has no other
    with pytest.raises(Exception, match="unknown rule"):
        both("rule_7", 0)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


class Echo:
    """A backend that answers with its seed and options, and counts how often it is loaded in a folder of files."""

    def __init__(self, folder):
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

    def ground(self, image_ids, images, phrases, seeds, **options):
        return [([[float(s), 0.0, 1.0, 1.0]], float(options.get("temperature", 0)), float(len(p))) for s, p in zip(seeds, phrases, strict=True)]

    def attend(self, image_ids, images, phrases, **options):
        return [[np.full((2, 3), float(i)), np.full((2, 3), float(i) + 1)] if int(i) % 2 else [] for i in image_ids]


def _prompts(spark, n):
    return spark.createDataFrame([(f"{i:02}", "worker") for i in range(n)], "image_id string, phrase string")


def test_reruns_are_runs_of_their_own(spark, tmp_path):
    folder = str(tmp_path)
    got = inference.reruns(_prompts(spark, 6), lambda: Echo(folder), 4).collect()
    assert sorted((r.image_id, r.run) for r in got) == [(f"{i:02}", k) for i in range(6) for k in range(1, 5)]
    assert all(r.boxes[0][0] == r.run and r.confidence == 0.7 and r.inference_ms == 6 for r in got)
    assert {r.boxes[0][0] for r in inference.run_task(_prompts(spark, 3), lambda: Echo(folder), seed=2).collect()} == {2.0}
    with pytest.raises(ValueError):
        inference.reruns(_prompts(spark, 6), lambda: Echo(folder), 0)


def test_recorded_reruns(spark):
    recorded = spark.createDataFrame([("00", "worker", 1, 0.5), ("00", "worker", 3, 0.7), ("01", "other", 1, 0.1)], "image_id string, phrase string, run int, confidence double")
    got = sorted((r.image_id, r.run, r.confidence) for r in inference.replay_runs(_prompts(spark, 2), recorded, 3).collect())
    assert got == [("00", 1, 0.5), ("00", 2, None), ("00", 3, 0.7), ("01", 1, None), ("01", 2, None), ("01", 3, None)]


def test_a_worker_loads_its_backend_once(spark, tmp_path):
    folder = str(tmp_path)
    rows = _prompts(spark, 60).repartition(12)
    load = lambda: Echo(folder)
    for _ in range(2):
        assert inference.run_task(rows, load).count() == 60 and inference.run_task(rows, load, temperature=0.3).agg(F.max("confidence")).first()[0] == 0.3
    loads = [x.split("-")[0] for x in os.listdir(folder)]
    assert 0 < len(loads) == len(set(loads)) <= 8  # four threads; 48 tasks have asked


def test_attention_of_a_backend(spark, tmp_path):
    folder = str(tmp_path)
    got = inference.attention(_prompts(spark, 6), lambda: Echo(folder)).collect()
    assert sorted((r.image_id, r.step, tuple(r.weights)) for r in got) == sorted((f"{i:02}", k, (float(i + k),) * 3) for i in (1, 3, 5) for k in (0, 1) for _ in range(2))
    maps = attribution.heat_maps(_prompts(spark, 2), inference.attention(_prompts(spark, 2), lambda: Echo(folder)), ["image_id", "phrase"], 2)
    assert {r.image_id: r.n_generated_tokens for r in maps.collect()} == {"00": 0, "01": 2}


def test_colours_are_grounded_in_pixels(spark):
    picture = np.zeros((4, 5, 3), np.uint8)
    picture[1:3, 2:5, 0] = 200
    picture[2, 2, 0] = 90
    image = {"height": 4, "width": 5, "pixels": bytearray(picture.tobytes())}
    rows = spark.createDataFrame([("a", "red", image), ("b", "blue", image), ("c", "red", None), ("d", "hat", image)], "image_id string, phrase string, image struct<height: int, width: int, pixels: binary>")
    got = {r.image_id: (r.boxes, r.confidence) for r in inference.run_task(rows, inference.ColourBackend).collect()}
    assert got == {"a": ([[2.0, 1.0, 5.0, 3.0]], pytest.approx(5 / 6)), "b": ([], 0.0), "c": ([], None), "d": ([], None)}
    assert inference.run_task(rows.filter("image_id = 'a'"), inference.ColourBackend, level=80).first().confidence == 1.0
    assert {r.image_id: len(r.weights) for r in inference.attention(rows, inference.ColourBackend).collect()} == {"a": 21, "b": 21}


def test_patch_candidates(spark):
    rows = spark.createDataFrame([(f"{i:03}", ("ppe_violation", "compliant")[i % 5 == 0], ("rule_1", "rule_2")[i % 7 == 0], i % 3) for i in range(200)], "image_id string, primary_class string, assigned_rule_id string, workers int")
    got = [r.image_id for r in metrics.patch_candidates(rows, F.col("workers"), [F.col("image_id")]).collect()]
    assert sorted(got) == [f"{i:03}" for i in range(200) if i % 5 and i % 7 and i % 3][:20]
    head, hat = (10.0, 5.0, 40.0, 30.0), images.hard_hat_patch()
    df = spark.createDataFrame([(1, 48, 64, bytearray(48 * 64 * 3), head), (2, 48, 64, bytearray(48 * 64 * 3), None), (3, 48, 64, None, head)], f"k int, height int, width int, pixels binary, box {BOX}")
    got = {r.k: r.pixels for r in images.paste_patches(df, hat).collect()}
    assert (np.frombuffer(got[1], np.uint8).reshape(48, 64, 3) == images.paste_patch(np.zeros((48, 64, 3), np.uint8), head, hat)).all() and not any(got[2]) and got[3] is None


def test_long_rates(spark):
    rows = spark.createDataFrame([("compliant", "rule_1", True), ("compliant", "rule_2", False), ("fall_hazard", "rule_2", None), (None, "rule_2", True)], "primary_class string, assigned_rule_id string, hit boolean")
    got = {(r.level, r["class"], r.rule): (r.rate, r.n) for r in relational.rates_long(rows, F.col("hit")).collect()}
    assert got == {
        ("overall", None, None): (pytest.approx(2 / 3), 4),
        ("class", "compliant", None): (0.5, 2), ("class", "fall_hazard", None): (None, 1), ("class", None, None): (1.0, 1), ("class", "ppe_violation", None): (None, 0), ("class", "struck_by_risk", None): (None, 0),
        ("rule", None, "rule_1"): (1.0, 1), ("rule", None, "rule_2"): (0.5, 3),
        ("class_rule", "compliant", "rule_1"): (1.0, 1), ("class_rule", "compliant", "rule_2"): (0.0, 1), ("class_rule", "fall_hazard", "rule_2"): (None, 1), ("class_rule", None, "rule_2"): (1.0, 1),
    }


def test_efficiency_of_four_stages(spark):
    n = 40
    ms, regions, shown, runs = ([float(i * k % 17 + 1) for i in range(n)] for k in (3, 5, 7, 11))
    ids = [f"{i:03}" for i in range(n)]
    counts = [int(x) % 4 or 16 for x in regions]
    predictions = spark.createDataFrame([(i, "rule_1", m) for i, m in zip(ids, ms, strict=True)], "image_id string, assigned_rule_id string, inference_ms double")
    held = spark.createDataFrame([(i, "rule_1", c, "grid" if c == 16 else "model") for i, c in zip(ids, counts, strict=True)], "image_id string, assigned_rule_id string, n_regions int, top_region_source string")
    timed = lambda v: spark.createDataFrame(list(zip(ids, v, strict=True)), "image_id string, ms double")
    got = {r.day: r for r in metrics.efficiency(predictions, held, timed(shown), timed(runs)).collect()}
    cost = [m * (2 if c >= 2 else 1) for m, c in zip(ms, counts, strict=True)]
    scored = np.mean([s for s, c in zip(shown[:15], counts, strict=False) if c != 16])
    assert (got[3].mean_ms_per_sample, got[3].observed_total_seconds, got[3].n_observed) == (pytest.approx(np.mean(ms)), pytest.approx(sum(ms) / 1000), "40")
    assert (got[5].calls_per_sample, got[5].mean_ms_per_call, got[5].mean_ms_per_sample) == pytest.approx((np.mean([2 if c >= 2 else 1 for c in counts]), np.mean(ms), np.mean(cost)))
    assert (got[6].mean_ms_per_call, got[6].observed_total_seconds, got[6].n_observed) == (pytest.approx(scored), pytest.approx(scored * n / 1000), "15 calibration samples, scaled to 40")
    assert (got[7].calls_per_sample, got[7].mean_ms_per_sample, got[7].extrapolated_1000_hours) == pytest.approx((3, 3 * np.mean(runs[:15]), 3 * np.mean(runs[:15]) / 3600))
    assert got[3].name == "baseline_inference" and got[7].extrapolated_1000_minutes == pytest.approx(3 * np.mean(runs[:15]) / 60)


def test_rates_skip_nan(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("b", None)], "k string, v double")
    assert {r.k: r.rate for r in relational.rate_by(rows, "k", F.col("v")).collect()} == {"a": 1.0, "b": None}


def test_balanced_sample(spark):
    rows = spark.range(4000).select(F.format_string("%07d", "id").alias("image_id"), F.when(F.col("id") % 50 == 0, "struck_by_risk").otherwise("compliant").alias("primary_class"), F.when(F.col("id") % 50 == 0, F.array(F.lit("rule_4"))).otherwise(F.array().cast("array<string>")).alias("violated_rules"))
    got = sampling.balanced_sample(rows, 40, 42, F.col("image_id")).collect()
    assert len(got) == 80 and {r.assigned_rule_id for r in got if r.primary_class == "struck_by_risk"} == {"rule_4"}
    assert [sum(r.assigned_rule_id == f"rule_{k}" for r in got if r.primary_class == "compliant") for k in (1, 2, 3, 4)] == [10] * 4
    assert {r.image_id for r in got} == {r.image_id for r in sampling.balanced_sample(rows.repartition(7), 40, 42, F.col("image_id")).collect()}
    assert {r.primary_class: r.n for r in sampling.class_counts(rows).collect()}["fall_hazard"] == 0


def test_images():
    checker = ((np.indices((40, 40)).sum(axis=0) // 5 % 2)[..., None] * np.array([255, 255, 255])).astype(np.uint8)
    assert images.blur(checker).std() < checker.std() and (images.blur(checker, 0) == checker).all()
    assert (images.low_light(checker, 1.0) == checker).all() and images.low_light(np.full((2, 2, 3), 100, np.uint8)).max() < 100
    for h, w, part in ((50, 41, 0.2), (7, 30, 0.5), (4, 4, 0.0)):
        dark = (images.occlude(np.full((h, w, 3), 9, np.uint8), part) == 0).all(axis=2)
        side = round((part * h * w) ** 0.5)
        assert dark.sum() == min(side, h) * side and (not side or abs(np.argwhere(dark)[:, 1].mean() - (w - 1) / 2) <= 0.5)
    assert (images.contrast_shift(checker, 1.0) == checker).all() and images.contrast_shift(checker, 0.3).std() < checker.std()
    white = np.full((20, 20, 3), 255, np.uint8)
    masked = images.mask_region(white, (2, 3, 5.5, 6))
    assert (masked[3:6, 2:6] == 0).all() and masked.sum() == white.sum() - 255 * 3 * 12
    assert (images.mask_region(white, (30, 30, 40, 40)) == white).all()
    with pytest.raises(ValueError):
        images.mask_region(white, (0, 0, 1, 1), "red")
    assert (images.paste_patch(white, (0, 0, 4, 4), np.zeros((2, 2, 3), np.uint8))[:4, :4] == 0).all()
    heat = np.zeros((24, 24))
    assert (images.overlay_heatmap(white, heat) == white).all()
    heat[0, 0] = 1
    assert images.overlay_heatmap(white, heat)[0, 0, 1] < 255
    assert tuple(images.overlay_boxes(white, [(0, 0, 10, 10)])[0, 0]) == (255, 0, 0)


def test_labels_on_pictures():
    grey = np.full((40, 50, 3), 90, np.uint8)
    plain = images.overlay_boxes(grey, [(5, 20.7, 30, 35)])
    named = images.overlay_boxes(grey, [(5, 20.7, 30, 35)], ["hard hat"])
    changed = (plain != named).any(axis=2)
    assert changed.sum() == images.lettering("hard hat").sum() and set(np.argwhere(changed)[:, 0]) == set(range(8, 13)) and np.argwhere(changed)[:, 1].min() == 7
    top = images.overlay_boxes(grey, [(30, 2, 45, 30)], ["w? long"])  # at the top, cut off at the right
    assert (top[:2] != 90).any(axis=2).sum() == images.lettering("w? long")[:2, :18].sum()
    outline = (plain != grey).any(axis=2)
    assert outline[20:36, 5:31].sum() == outline.sum() == 26 * 16 - 20 * 10  # corners included, three wide
    assert (images.overlay_boxes(grey, [(9, 9, 5, 5), (60, 60, 70, 70)]) == grey).all()
    assert (images.overlay_boxes(grey, [(45, 10, 80, 30)])[10:31, 48:] == grey[10:31, 48:])[3:18].all()  # its right side is outside
    assert (images.overlay_boxes(grey, [(1, 1, 9, 9), (20, 20, 29, 29)], ["only"]) == images.overlay_boxes(grey, [(1, 1, 9, 9)], ["only"])).all()
    assert len({images.lettering(c).tobytes() for c in images.GLYPHS}) == len(images.GLYPHS)


def _line(values, size, kernel, reach):
    """A line of samples resized, one at a time, in whole levels."""
    out, scale = [], len(values) / size
    wide = max(scale, 1)
    for o in range(size):
        centre = (o + 0.5) * scale
        at = range(max(0, int(max(centre - reach * wide + 0.5, 0))), min(len(values), int(centre + reach * wide + 0.5)))
        w = [kernel(abs((i - centre + 0.5) / wide)) for i in at]
        out.append(min(255, max(0, math.floor(sum(values[i] * x for i, x in zip(at, w, strict=True)) / sum(w) + 0.5))))
    return out


@pytest.mark.parametrize(("name", "kernel", "reach"), [("bilinear", lambda d: max(0, 1 - d), 1), ("bicubic", lambda d: 1.5 * d**3 - 2.5 * d**2 + 1 if d < 1 else -0.5 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0, 2)])
def test_resizing(name, kernel, reach):
    rng = np.random.default_rng(5)
    for (h, w), (to_h, to_w) in (((5, 6), (11, 3)), ((24, 24), (30, 47)), ((60, 60), (7, 9)), ((4, 4), (4, 4)), ((1, 1), (3, 2))):
        image = rng.integers(0, 256, (h, w, 3), np.uint8)
        wide = np.array([[_line(image[y, :, c].tolist(), to_w, kernel, reach) for c in range(3)] for y in range(h)]).transpose(0, 2, 1)
        want = np.array([[_line(wide[:, x, c].tolist(), to_h, kernel, reach) for c in range(3)] for x in range(to_w)]).transpose(2, 0, 1)
        got = images.resized(image, to_h, to_w, name)
        assert got.shape == want.shape and abs(got.astype(int) - want).max() <= 1 and (got != want).mean() < 0.1  # halves fall either way: weights are whole numbers there
    assert (images.resized(np.full((3, 5, 3), 200, np.uint8), 9, 4, name) == 200).all()


def test_heat_maps_are_cut_to_levels():
    rng = np.random.default_rng(9)
    image, heat = rng.integers(0, 256, (48, 72, 3), np.uint8), rng.random((24, 24)) * 1.4 - 0.2
    levels = images.resized((np.clip(heat, 0, 1) ** 0.7 * 255).astype(np.uint8), 48, 72, "bilinear")
    got = images.overlay_heatmap(image, heat, 0.6, 0.7)
    for y, x in ((0, 0), (47, 71), (13, 40)):
        share = 0.6 * (levels[y, x] / 255)
        assert got[y, x].tolist() == [int(image[y, x, c] * (1 - share) + (255.0 if c == 0 else 0.0) * share) for c in range(3)]


def test_contrast_is_about_whole_greys():
    image = np.array([[[10, 200, 30], [255, 255, 255]], [[0, 0, 0], [1, 2, 3]]], np.uint8)
    greys = [(19595 * r + 38470 * g + 7471 * b + 32768) >> 16 for r, g, b in image.reshape(-1, 3).tolist()]
    mean = int(sum(greys) / 4 + 0.5)
    assert images.contrast_shift(image, 0.5).ravel().tolist() == [int(mean + 0.5 * (v - mean)) for v in image.ravel().tolist()]
    assert images.contrast_shift(image, 0.0).ravel().tolist() == [mean] * 12


def test_null_pixels_stay_null(spark):
    df = spark.createDataFrame([("a", 1, 1, bytearray(b"abc")), ("b", 1, 1, None)], "name string, height int, width int, pixels binary")
    assert {r.name: r.pixels is None for r in images.perturb(df, "low_light").collect()} == {"a": False, "b": True}


def test_cells_that_are_no_numbers(spark):
    rows = spark.createDataFrame([("1.5",), ("n/a",), ("NaN",), (None,), ("",)], "x string")
    assert [r.x for r in rows.select(tables.number(F.col("x")).alias("x")).collect()] == [1.5, None, None, None, None]


def test_inference_is_asked_for_what_is_left_only(spark, tmp_path):
    folder, rows = str(tmp_path), _prompts(spark, 20)
    a = inference.run_task(rows.filter("image_id < '10'"), lambda: Echo(folder)).orderBy("image_id").collect()
    b = inference.run_task(rows.repartition(3), lambda: Echo(folder)).filter("image_id < '10'").orderBy("image_id").collect()
    assert a == b and len(a) == 10


def test_csv_keeps_ids_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("0000007", "rule_1", "compliant", "compliant", '["compliant", "violation"]', 1.0, "compliant", True, math.nan, None)], tables.SCHEMAS["stability"])
    tables.write_csv(rows, str(tmp_path / "t"))
    got = tables.read_csv(spark, str(tmp_path / "t"), "stability").first()
    assert got.image_id == "0000007" and got.sampled_answers == '["compliant", "violation"]' and got.deterministic_matches_majority is True and got.top_region_overlap_score is None


def test_stream_gives_the_batch_rates(spark, tmp_path):
    from lumenlake.streaming import windows

    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src).orderBy("ts")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.rates(windows.read_events(spark, str(tmp_path / "in"), batch.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")), "1 hour")
    q = windows.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).select("start", "event_type", "n").collect()}
    want = {tuple(r)[:3] for r in windows.rates(batch, "1 hour").select("start", "event_type", "n").collect()}
    assert got <= want and len(got) > 0.8 * len(want)  # the last windows stay open
