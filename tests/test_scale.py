"""What must hold for groups and pictures of any size: places in an order, quantiles, closeness in crowds."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenlake import workers
from lumenlake.operators import metrics, near, ordering, quantiles
from lumenlake.sources import tables
from lumenlake.streaming import pools


def test_places_in_an_order(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("x"), (F.col("id") % 3).alias("y")).repartition(5)
    table = tables.stored(ordering.in_ranges(rows, [F.desc("y"), F.col("x")]), "t")
    assert len(ordering.starts(table)) == 4  # as many as spark.sql.shuffle.partitions
    got = {(r.y, r.x): r.place for r in ordering.placed(table).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(got, key=lambda k: (-k[0], k[1])) and sorted(got.values()) == list(range(3000))
    assert ordering.placed(tables.stored(ordering.in_ranges(rows.filter("false"), [F.col("x")]), "t")).count() == 0


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([1.0, 1.0, rng.random() * 9])) for _ in range(3000)] + [(k, float(rng.randrange(5))) for k in ("a", "b", None) for _ in range(rng.randrange(1, 9))]
    rows += [("one", 4.5), ("nan", math.nan), ("nan", None), ("neg", -0.0), ("neg", 0.0), ("big", 1e300), ("big", -1e300), ("a", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6).withColumn("_v", F.lit("clash"))
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p100": 1.0}
    got = {r.k: [r[p] for p in points] for r in quantiles.exact(df, ["k"], F.col("v"), points).collect()}
    groups = {k: [v for x, v in rows if x == k and v is not None and v == v] for k, _ in rows}
    assert set(got) == {k for k, v in groups.items() if v}
    for k, held in got.items():
        assert held == pytest.approx(np.quantile(groups[k], list(points.values())).tolist())
    whole = quantiles.exact(df, [], F.col("v"), {"m": 0.5}).collect()
    assert [r.m for r in whole] == [pytest.approx(np.median([v for g in groups.values() for v in g]))]
    assert quantiles.exact(df.filter("false"), ["k"], F.col("v"), {"m": 0.5}).count() == 0 and quantiles.exact(df.filter("false"), [], F.col("v"), {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact(df, ["k"], F.col("v"), {"m": 1.5})


def test_a_hot_group_is_dealt_to_ranges(spark):
    """No range has much more than its share of one group's values."""
    rows = spark.range(4000).select((F.col("id") * 7919 % 4001).cast("double").alias("v"))
    ranged = tables.stored(ordering.in_ranges(rows, [F.col("v")]), "t")
    sizes = [r["count"] for r in ranged.groupBy(ordering.range_of()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_timings_of_groups_without_numbers(spark):
    rows = spark.createDataFrame([("a", 100.0), ("a", 200.0), ("a", 400.0), ("b", None), (None, 7.0)], "stage string, ms double")
    got = {r.stage: r for r in metrics.timings(rows, ["stage"], F.col("ms")).collect()}
    assert (got["a"].n, got["a"].median_ms, got["a"].max_ms) == (3, 200.0, 400.0) and (got["b"].n, got["b"].median_ms) == (0, None) and got[None].median_ms == 7.0


def _close(a, b, limit):
    dx, dy = max(b[0] - a[2], a[0] - b[2], 0), max(b[1] - a[3], a[1] - b[3], 0)
    return math.hypot(dx, dy) <= limit


def _scene(rng, n, spread, sizes):
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-spread, spread), rng.uniform(-spread, spread), rng.choice(sizes), rng.choice(sizes)
        out.append((rng.randrange(3), i, x, y, *((x + w, y + h) if rng.random() < 0.9 else (x - w, y - h))))  # some are inverted
    return out


BOXES = "sample_id int, ord int, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize(("spread", "sizes", "limit"), [(200, [0, 1, 7, 30], 4.0), (50, [0.1, 400], 0.0), (3000, [2, 900], 25.0), (1e-3, [1e-4], 1e-4)])
def test_closeness_equals_all_pairs(spark, spread, sizes, limit):
    rng = random.Random(int(spread))
    subjects, references = _scene(rng, 150, spread, sizes), _scene(rng, 120, spread, sizes)
    subjects += [(1, 900, None, 0.0, 1.0, 1.0), (7, 901, 0.0, 0.0, 1.0, 1.0)]  # no corner; no reference in its sample
    references += [(1, 900, math.nan, 0.0, 1.0, 1.0), (8, 901, 0.0, 0.0, 1.0, 1.0), (1, 902, math.inf, 0.0, 1.0, 1.0)]
    a, b = spark.createDataFrame(subjects, BOXES).repartition(3), spark.createDataFrame(references, BOXES)
    whole = lambda r: None not in r and all(map(math.isfinite, r))
    want = {(s[0], s[1], r[1]) for s in subjects for r in references if s[0] == r[0] and whole(s) and whole(r) and _close(s[2:], r[2:], limit)}
    found = [tuple(r) for r in near.pairs(a, b, limit).collect()]
    assert Counter(found) == Counter(want)
    assert Counter(tuple(r) for r in near.near(a, b, limit).collect()) == Counter({(s, i) for s, i, _ in want})
    samples = spark.createDataFrame([(i,) for i in (0, 1, 2, 7, 8, 9)], "sample_id int")
    got = {r.sample_id: r for r in near.coverage(samples, a, b, limit).collect()}
    for k in (0, 1, 2, 7, 8, 9):
        own = [s for s in subjects if s[0] == k]
        bare = sum((k, s[1]) not in {(x, i) for x, i, _ in want} for s in own)
        refs = any(r[0] == k for r in references)
        assert (got[k].subjects, got[k].bare, got[k].proximity) == (len(own), bare, "hazard" if bare < len(own) else "safe")
        assert got[k].answer == (("compliant" if refs else "violation") if not own else "violation" if bare else "compliant")


def test_a_crowd_is_not_all_pairs(spark):
    """Forty thousand boxes in one picture, with a huge one on each side: what is compared stays near what is close."""
    side = lambda shift: spark.range(20001).select(F.lit(0).alias("sample_id"), F.col("id").alias("ord"), ((F.col("id") * 7919 + shift) % 6000).cast("double").alias("x0"), ((F.col("id") * 104729 + shift) % 5987).cast("double").alias("y0"), F.when(F.col("id") == 0, 4000.0).otherwise(6.0).alias("w"))
    a, b = (s.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("w")}) for s in (side(0), side(3)))
    compared = near.candidates(a, b, 4.0).count()
    close = near.pairs(a, b, 4.0).count()
    assert 0 < close <= compared < 20 * close and compared < 20000 * 20000 / 500


def test_subjects_in_one_place_are_settled_at_once(spark):
    a = spark.range(3000).select(F.lit(0).alias("sample_id"), F.col("id").alias("ord"), *(F.lit(float(v)).alias(c) for c, v in zip(near.CORNERS, (10, 10, 20, 20), strict=True)))
    assert near.near(a, a, 1.0).count() == 3000


def _arrays(boxes):
    return [(np.stack([b[c].to_numpy(float) for c in near.CORNERS]), b) for b in boxes]


@pytest.mark.parametrize(("wide", "high"), [(3000, 50), (50, 3000)])
def test_crowds_are_counted_by_slabs(spark, monkeypatch, wide, high):
    """Samples of very many slabs and of one, cut along either axis, with boxes over many slabs: as all pairs say."""
    monkeypatch.setattr(near, "SLAB", 60)
    rng = np.random.default_rng(wide)
    sides = []
    for n in (900, 700):
        x, y, w, h = rng.integers(0, wide, n) / 3, rng.integers(0, high, n) / 4, rng.choice([-2, 0, 1, 9, 700], n, p=[0.05, 0.2, 0.3, 0.4, 0.05]), rng.choice([0, 2, 7, 300], n)
        sides.append(pd.DataFrame({"sample_id": rng.choice([1, 2, 3], n, p=[0.8, 0.18, 0.02]), "ord": np.arange(n), "x0": x, "y0": y, "x1": x + w, "y1": y + h}))
    (one, a), (two, b) = _arrays(sides)
    made = [spark.createDataFrame(t).repartition(3) for t in sides]
    for limit in (0.0, 2.0, 25.0):
        want = np.array([near._one_by_one(one[:, [i]], two[:, (b.sample_id == a.sample_id[i]).to_numpy()], limit)[0] for i in range(len(a))])
        assert {tuple(r) for r in near.pair_counts(*made, limit).collect()} == {(int(k), int(v)) for k, v in pd.Series(want).groupby(a.sample_id).sum().items() if v}
        assert sorted(tuple(r) for r in near.near(*made, limit).collect()) == sorted((int(a.sample_id[i]), i) for i in np.flatnonzero(want))
        assert {tuple(r) for r in near._near_counts(*made, limit).collect()} == {(int(k), int(v)) for k, v in pd.Series(want > 0).groupby(a.sample_id).sum().items() if v}
        assert sum(r.pairs for r in near.pair_counts(*made, limit).collect()) == near.pairs(*made, limit).count()


def test_as_many_pairs_as_would_never_end(spark):
    """Sixteen hundred million pairs of one place."""
    a = spark.range(40000).select(F.lit(0).alias("sample_id"), F.col("id").alias("ord"), *(F.lit(float(v)).alias(c) for c, v in zip(near.CORNERS, (10, 10, 20, 20), strict=True)))
    assert near.pair_counts(a, a, 1.0).first().pairs == 40000**2


def test_workers_keep_the_latest_of_a_kind():
    made = []
    make = lambda x: lambda: made.append(x) or [x]
    first = workers.kept("test", 1, make(1))
    assert workers.kept("test", 1, make(2)) is first and workers.kept("test", 2, make(3)) == [3] and workers.kept("test", 1, make(4)) == [4] and made == [1, 3, 4]


def test_pools_of_a_stream_survive_a_restart(spark, tmp_path):
    rng = random.Random(4)
    classes, parts = ["often", "rare", "some"], 6
    rows = [(f"{i:05}", rng.choices(classes, [8, 1, 3])[0], rng.randrange(1000)) for i in range(900)]
    schema, cap, want = "image_id string, primary_class string, pos int", 25, {c: [] for c in classes}
    for k in range(parts):  # a file each, one after the other
        part = rows[150 * k : 150 * (k + 1)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for r in sorted(part, key=lambda r: (r[2], r[0])):
            if len(want[r[1]]) < cap:
                want[r[1]].append(r[0])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda **more: pools.fill(stream, classes, "primary_class", "image_id", "pos", cap, str(tmp_path / "out"), str(tmp_path / "cp"), **more)
    batches = lambda: sorted(p.name for p in (tmp_path / "out").glob("batch=*"))
    run(wait=lambda q: len(batches()) >= 1)  # stopped early
    assert 1 <= len(batches()) < parts
    got = {c: [None] * cap for c in classes}
    found = run().collect()
    for r in found:
        got[r.primary_class][r.place - 1] = r.image_id
    assert got == want and len(found) == sum(map(len, want.values())) == 3 * cap
    n = len(batches())
    assert run().count() == len(found) and len(batches()) == n < parts + 1  # full: nothing more is read
    with pytest.raises(ValueError):
        pools.pools(stream, "primary_class", "image_id", "pos", 0)
