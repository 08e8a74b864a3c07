"""What the reference only plans: intervals, tests between classes, agreement of attention with boxes."""

import hashlib
import math
import random
from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import geometry as g
from lumenlake.operators import crossmodal, intervals, rollout, stratify


def _replicates(rows, cls, seed, n):
    """The bootstrap by its rule, a row at a time."""
    at, out = intervals.thresholds(), []
    for r in range(n):
        total = weight = 0
        for key, c, v in rows:
            if c == cls and v is not None and v == v:
                d = hashlib.md5(f"{key}#{seed}#{r // 8}".encode()).hexdigest()
                w = sum(int(d[r % 8 * 4 : r % 8 * 4 + 4], 16) >= t for t in at)
                total, weight = total + w * v, weight + w
        if weight:
            out.append(total / weight)
    return out


def test_bootstrap_equals_its_rule(spark):
    rng = random.Random(7)
    rows = [(f"k{i}", rng.choice(["a", "a", "b", None]), rng.choice([0.0, 1.0, 2.5, None, math.nan])) for i in range(60)] + [("one", "c", 4.0), ("none", "d", None)]
    df = spark.createDataFrame(rows, "key string, cls_ string, v double").repartition(3)
    for seed in (1, 2):
        got = {r.cls_: r for r in intervals.bootstrap(df, F.col("key"), "cls_", F.col("v"), seed, 40, 0.9).collect()}
        assert set(got) == {"a", "b", None, "c"}
        for c, r in got.items():
            own = [v for _, x, v in rows if x == c and v is not None and v == v]
            means = _replicates(rows, c, seed, 40)
            assert (r.n, r.estimate) == (len(own), pytest.approx(np.mean(own))) and (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.05, 0.95])))
        assert (got["c"].low, got["c"].high) == (4.0, 4.0)
    assert intervals.bootstrap(df.filter("false"), F.col("key"), "cls_", F.col("v"), 1).count() == 0
    with pytest.raises(ValueError):
        intervals.bootstrap(df, F.col("key"), "cls_", F.col("v"), 1, 12)


def test_bootstrap_covers_and_narrows(spark):
    """Counts are those of a Poisson variable of mean 1, and intervals have about the width that theory gives."""
    assert sum(1 - t / 65536 for t in intervals.thresholds()) == pytest.approx(1, abs=1e-3)
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") < 400, "few").otherwise("many").alias("c"), (F.col("id") * 7919 % 10 < 3).alias("v"))
    got = {r.c: r for r in intervals.bootstrap(df, F.col("k"), "c", F.col("v"), 5).collect()}
    for c, n in (("few", 400), ("many", 3600)):
        assert got[c].high - got[c].low == pytest.approx(2 * 1.96 * math.sqrt(0.21 / n), rel=0.25) and got[c].low < 0.3 < got[c].high


def test_permutations_are_all_deals():
    rng = random.Random(1)
    for _ in range(40):
        n_a, n_b = rng.randrange(1, 7), rng.randrange(1, 7)
        hits_a, hits_b = rng.randint(0, n_a), rng.randint(0, n_b)
        marks = [1] * (hits_a + hits_b) + [0] * (n_a + n_b - hits_a - hits_b)
        seen = abs(Fraction(hits_a, n_a) - Fraction(hits_b, n_b))
        deals = [abs(Fraction(k := sum(marks[i] for i in chosen), n_a) - Fraction(sum(marks) - k, n_b)) >= seen for chosen in combinations(range(n_a + n_b), n_a)]
        assert intervals.permuted(hits_a, n_a, hits_b, n_b) == pytest.approx(sum(deals) / comb(n_a + n_b, n_a))
    assert intervals.permuted(0, 0, 3, 5) == 1.0 and intervals.permuted(5, 5, 3, 3) == 1.0
    far = intervals.permuted(600_000_000, 10**9, 599_900_000, 10**9)  # any number of rows: 4.6 deviations
    assert far == pytest.approx(math.erfc(1e-4 / math.sqrt(2 * 0.6 * 0.4 / 10**9) / math.sqrt(2)), rel=0.02)


def test_differences_of_classes(spark):
    rows = spark.createDataFrame([("a", True)] * 3 + [("a", False)] + [("b", False)] * 4 + [("b", None), (None, True)] + [("c", True)], "c string, hit boolean")
    got = {(r.first, r.second): (r.difference, r.p_value) for r in intervals.differences(rows, "c", F.col("hit")).collect()}
    assert got[("a", "b")] == (0.75, pytest.approx(10 / comb(8, 4))) and got[("a", "c")] == (-0.25, pytest.approx(1.0)) and set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert intervals.differences(rows.filter("false"), "c", F.col("hit")).count() == 0


def test_mass_in_boxes(spark):
    rng = random.Random(3)
    size, frame = (5, 7), (50.0, 84.0)
    maps = {k: [rng.random() if rng.random() < 0.8 else 0.0 for _ in range(35)] for k in range(12)} | {20: [0.0] * 35, 21: None, 22: [1.0] * 4}
    maps[3][4] = math.nan
    boxes = [(k, *(lambda x, y: (x, y, x + rng.uniform(-5, 70), y + rng.uniform(-5, 40)))(rng.uniform(-20, 80), rng.uniform(-20, 50))) for k in maps for _ in range(4)]
    areas = crossmodal.summed_area(spark.createDataFrame(list(maps.items()), "k int, heatmap array<double>"), size)
    df = spark.createDataFrame(boxes, "k int, x0 double, y0 double, x1 double, y1 double").join(areas, "k")
    box = g.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    got = df.select("k", "x0", "y0", "x1", "y1", crossmodal.mass_in(F.col("area"), box, size, frame).alias("mass"), crossmodal.points_at(F.col("peak"), box, size, frame).alias("hit")).collect()
    assert len(got) == len(boxes)
    for r in got:
        cells = maps[r.k]
        if cells is None or len(cells) != 35 or not sum(v for v in cells if v == v):
            assert r.mass is None
            continue
        plain = [0.0 if v != v else v for v in cells]
        inside = [r.x0 <= (i % 7 + 0.5) * 12 < r.x1 and r.y0 <= (i // 7 + 0.5) * 10 < r.y1 for i in range(35)]
        assert r.mass == pytest.approx(sum(v for v, x in zip(plain, inside, strict=True) if x) / sum(plain), abs=1e-12)
        assert r.hit is inside[plain.index(max(plain))]


def test_folds_keep_every_label(spark):
    rng = random.Random(11)
    for trial in range(200):
        sets = sorted({tuple(sorted(rng.sample("abcd", k))) for k in (0, 1, 1, 1, 2, 2, 3)})
        counts = {s: rng.choice([1, 2, 7, 40, 1000]) for s in sets}
        ratios = rng.choice([[0.8, 0.1, 0.1], [1, 1], [3, 1, 1, 1]])
        found = stratify.plan(counts, ratios)
        assert {s: sum(v) for s, v in found.items()} == counts and min(min(v) for v in found.values()) >= 0
        for j, r in enumerate(ratios):
            share = r / sum(ratios)
            for label in "abcd":
                n = sum(c for s, c in counts.items() if label in s)
                assert abs(sum(v[j] for s, v in found.items() if label in s) - share * n) <= 1 + 1e-9, (trial, counts, found)
            assert abs(sum(v[j] for v in found.values()) - share * sum(counts.values())) <= 1 + 1e-9


def test_rows_find_their_fold(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([["a"], ["b", "a"], ["a", "b", "a"], [], None, ["c"]])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, labels array<string>").repartition(5)
    got = {r.id: r.fold for r in stratify.split(df, F.col("labels"), F.col("id"), [0.5, 0.25, 0.25], 3).collect()}
    assert len(got) == 400 and got == {r.id: r.fold for r in stratify.split(df.repartition(2), F.col("labels"), F.col("id"), [0.5, 0.25, 0.25], 3).collect()}
    for label in ("a", "b", "c"):
        own = [got[i] for i, x in rows if x and label in x]
        assert all(abs(own.count(j) - share * len(own)) <= 1 for j, share in enumerate((0.5, 0.25, 0.25)))
    other = {r.id: r.fold for r in stratify.split(df, F.col("labels"), F.col("id"), [0.5, 0.25, 0.25], 4).collect()}
    assert other != got
    assert stratify.split(df.filter("false"), F.col("labels"), F.col("id"), [1, 1], 3).count() == 0
    with pytest.raises(ValueError):
        stratify.split(df, F.col("labels"), F.col("id"), [0, 0], 3)


@pytest.mark.parametrize(("size", "block"), [(7, 3), (4, 4), (5, 9), (6, 2)])
def test_rollout_is_a_chain_of_products(spark, size, block):
    rng = np.random.default_rng(size)
    rows, want = [], {}
    for image in ("a", "b"):
        chain = np.eye(size)
        for layer in (2, 5, 11):
            heads = rng.random((2, size, size))
            lacks = rng.integers(0, size) if layer == 5 else None
            rows += [(image, layer, i, head[i].tolist()) for head in heads for i in range(size) if i != lacks]
            mean = heads.mean(axis=0)
            if lacks is not None:
                mean[lacks] = 0
            step = mean + np.eye(size)
            chain = step / step.sum(axis=1, keepdims=True) @ chain
        want[image] = chain
    df = spark.createDataFrame(rows, "image string, layer int, row int, weights array<double>").repartition(4)
    got = rollout.rollout(df, ["image"], size, block).collect()
    assert len(got) == 2 * size
    for r in got:
        assert r.weights == pytest.approx(want[r.image][r.row].tolist()) and sum(r.weights) == pytest.approx(1)
    assert rollout.rollout(df.filter("false"), ["image"], size, block).count() == 0
