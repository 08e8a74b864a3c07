"""The named queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import geometry as g
from lumenlake.functions import heatmaps as h
from lumenlake.functions import labels, rules
from lumenlake.operators import attribution, crossmodal, decide, images, inference, intervals, metrics, near, quantiles, relational, rollout, sampling, stratify
from lumenlake.sources import pictures, tables
from lumenlake.streaming import pools, windows

from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _box(prefix: str = "") -> Column:
    return g.box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


# Geometry


def _box_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = a.boxes(spark, sf)
    left, right = b.filter("role = 'worker'").alias("w"), b.filter("role = 'object'").alias("o")
    return left.join(right, F.col("w.sample_id") == F.col("o.sample_id"))


_PAIRS = f"WITH {a.BOXES} SELECT w.sample_id, w.ord AS worker, o.ord AS object"
_FROM_PAIRS = "FROM boxes w JOIN boxes o ON w.sample_id = o.sample_id WHERE w.role = 'worker' AND o.role = 'object'"


@query(f"WITH {a.BOXES} SELECT sample_id, ord, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) AS area FROM boxes")
def box_area(spark: SparkSession, sf: str) -> DataFrame:
    return a.boxes(spark, sf).select("sample_id", "ord", g.area(_box()).alias("area"))


@query(f"{_PAIRS}, round({a.iou_sql('w', 'o')}, 6) AS iou {_FROM_PAIRS}")
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _box_pairs(spark, sf).select("w.sample_id", F.col("w.ord").alias("worker"), F.col("o.ord").alias("object"), _r(g.iou(_box("w."), _box("o."))).alias("iou"))


@query(f"{_PAIRS}, ({a.iou_sql('w', 'o')} > 0) OR {a.near_sql('w', 'o', '12')} AS close {_FROM_PAIRS}")
def boxes_close(spark: SparkSession, sf: str) -> DataFrame:
    return _box_pairs(spark, sf).select("w.sample_id", F.col("w.ord").alias("worker"), F.col("o.ord").alias("object"), g.close(_box("w."), _box("o."), 12.0).alias("close"))


@query(f"WITH {a.BOXES}, p AS (SELECT *, y1 - y0 AS h, x1 - x0 AS w FROM boxes WHERE role = 'worker'), q AS (SELECT *, h * 0.22 AS hh, least(w, h * 0.22 * 1.3) AS hw FROM p) "
       "SELECT sample_id, ord, round(x0 + (w - hw) / 2, 6) AS x0, round(y0, 6) AS y0, round(x0 + (w - hw) / 2 + hw, 6) AS x1, round(y0 + hh, 6) AS y1 FROM q")
def head_box(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.boxes(spark, sf).filter("role = 'worker'").select("sample_id", "ord", g.head(_box()).alias("b"))
    return rows.select("sample_id", "ord", *(_r(F.col(f"b.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"WITH {a.BOXES}, r AS (SELECT sample_id, ord, greatest(round_even(x0 * 3.1 - 20.5, 0), 0) AS x0, greatest(round_even(y0 * 3.1 - 20.5, 0), 0) AS y0, least(round_even(x1 * 3.1 - 20.5, 0), 640.0) AS x1, least(round_even(y1 * 3.1 - 20.5, 0), 480.0) AS y1 FROM boxes) "
       "SELECT sample_id, ord, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM (SELECT *, x1 > x0 AND y1 > y0 AS ok FROM r)")
def round_clip_box(spark: SparkSession, sf: str) -> DataFrame:
    wide = g.box(*(F.col(c) * 3.1 - 20.5 for c in ("x0", "y0", "x1", "y1")))
    rows = a.boxes(spark, sf).select("sample_id", "ord", g.to_frame(wide, F.lit(a.WIDTH), F.lit(a.HEIGHT)).alias("b"))
    return rows.select("sample_id", "ord", *(F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("WITH s AS (SELECT DISTINCT n_nationkey AS k, 100.0 + n_nationkey * 10 AS w, 80.0 + n_regionkey * 20 AS h FROM nation) "
       "SELECT k, r.i * 4 + c.i AS cell, round((c.i * (w / 4))::DOUBLE, 6) AS x0, round((r.i * (h / 4))::DOUBLE, 6) AS y0, round(((c.i + 1) * (w / 4))::DOUBLE, 6) AS x1, round(((r.i + 1) * (h / 4))::DOUBLE, 6) AS y1 FROM s, range(4) r(i), range(4) c(i)")
def grid_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (100.0 + F.col("n_nationkey") * 10).alias("w"), (80.0 + F.col("n_regionkey") * 20).alias("h"))
    cells = rows.select("k", F.posexplode(g.grid(F.col("w"), F.col("h"))).alias("cell", "b"))
    return cells.select("k", F.col("cell").cast("long").alias("cell"), *(_r(F.col(f"b.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"WITH {a.RANKED} SELECT sample_id, ord, rank, area FROM ranked")
def rank_regions(spark: SparkSession, sf: str) -> DataFrame:
    return a.ranked(spark, sf).select("sample_id", "ord", "rank", "area")


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = decide.in_row(a.samples(spark, sf), a.boxes(spark, sf))
    names = labels.box_labels(F.col("assigned_rule_id"), F.size("workers"), F.size("objects"))
    return rows.withColumn("regions", g.rank_regions(F.concat("workers", "objects"), names, F.lit(a.WIDTH), F.lit(a.HEIGHT)))


@query(f"WITH {a.SAMPLES}, {a.RANKED}, n AS (SELECT sample_id, count(*) AS n FROM boxes GROUP BY 1) "
       "SELECT s.image_id, s.assigned_rule_id, CASE WHEN n.n IS NULL THEN 16 ELSE n.n END AS n_regions, CASE WHEN n.n IS NULL THEN 'grid' ELSE 'model' END AS source, "
       "CASE WHEN n.n IS NULL THEN 'grid' WHEN t.role = 'worker' THEN 'worker' ELSE CASE s.assigned_rule_id WHEN 'rule_1' THEN 'hard hat' WHEN 'rule_2' THEN 'harness' WHEN 'rule_3' THEN 'guardrail' ELSE 'excavator' END END AS label, "
       "coalesce(t.x0, 0.0) AS x0, coalesce(t.x1, 160.0) AS x1 FROM samples s LEFT JOIN n USING (sample_id) LEFT JOIN ranked t ON t.sample_id = s.sample_id AND t.rank = 1")
def top_region(spark: SparkSession, sf: str) -> DataFrame:
    rows = _regions(spark, sf).withColumn("t", g.top(F.col("regions")))
    return rows.select("image_id", "assigned_rule_id", F.size("regions").cast("long").alias("n_regions"), F.col("t.source").alias("source"), F.col("t.label").alias("label"), F.col("t.box.x0").alias("x0"), F.col("t.box.x1").alias("x1"))


# Answers

_ANSWERS = f"WITH {a.RANKED}, {a.answer_sql('full', 0)}"


@query(f"{_ANSWERS} SELECT sample_id, answer FROM \"full\"".replace("full AS", '"full" AS'))
def coverage_answer(spark: SparkSession, sf: str) -> DataFrame:
    return decide.coverage_exploded(a.samples(spark, sf), a.boxes(spark, sf), a.NEAR)


@query(_SQL["coverage_answer"])
def coverage_answer_in_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = decide.in_row(a.samples(spark, sf), a.boxes(spark, sf))
    return rows.select("sample_id", decide.presence(F.col("workers"), F.col("objects"), F.lit(a.NEAR)).alias("answer"))


@query(f"WITH {a.SAMPLES}, {a.RANKED}, {a.answer_sql('base', 0)} SELECT primary_class, avg((answer = 'violation')::INT) AS violation_rate, count(*) AS n FROM samples JOIN base USING (sample_id) GROUP BY 1")
def coverage_rate_by_class(spark: SparkSession, sf: str) -> DataFrame:
    answers = decide.coverage_exploded(a.samples(spark, sf), a.boxes(spark, sf), a.NEAR)
    return relational.rate_by(a.samples(spark, sf).join(answers, "sample_id"), "primary_class", F.col("answer") == "violation", "violation_rate")


@query(f"WITH {a.BOXES}, s AS (SELECT o_orderkey AS sample_id FROM orders) SELECT s.sample_id, CASE WHEN EXISTS (SELECT 1 FROM boxes w JOIN boxes o ON w.sample_id = o.sample_id WHERE w.sample_id = s.sample_id AND w.role = 'worker' AND o.role = 'object' AND {a.near_sql('w', 'o', '32')}) THEN 'hazard' ELSE 'safe' END AS answer FROM s")
def proximity_answer(spark: SparkSession, sf: str) -> DataFrame:
    rows = decide.in_row(a.samples(spark, sf), a.boxes(spark, sf))
    return rows.select("sample_id", decide.proximity(F.col("workers"), F.col("objects"), g.threshold(rules.THRESHOLD["rule_4"], F.lit(a.WIDTH), F.lit(a.HEIGHT))).alias("answer"))


# Ten pictures of very many boxes each, of all sizes; a third of them in one place
_CROWD = """crowd AS (SELECT *, x0 + w AS x1, y0 + w * 0.75 AS y1 FROM (SELECT l_suppkey % 10 AS sample_id, CASE WHEN l_returnflag = 'R' THEN 'object' ELSE 'worker' END AS role,
  CASE WHEN l_suppkey % 3 = 0 THEN 100 ELSE 0 END + (l_partkey * 7919 + l_orderkey * 13) % CASE WHEN l_suppkey % 3 = 0 THEN 50 ELSE 40000 END * 1.0::DOUBLE AS x0, (l_orderkey * 6007 + l_linenumber * 97) % 30000 * 1.0::DOUBLE AS y0,
  CASE WHEN l_quantity >= 50 THEN 2000.0 WHEN l_quantity >= 45 THEN 150.0 ELSE l_quantity END::DOUBLE AS w FROM lineitem))"""


def _crowd(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, workers and objects."""
    t = a.table(spark, sf, "lineitem")
    dense, size = F.col("l_suppkey") % 3 == 0, F.col("l_quantity")
    x0 = F.when(dense, 100).otherwise(0) + (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 13) % F.when(dense, 50).otherwise(40000)
    w = F.when(size >= 50, 2000.0).when(size >= 45, 150.0).otherwise(size)
    rows = t.select((F.col("l_suppkey") % 10).alias("sample_id"), (F.col("l_returnflag") == "R").alias("is_object"), F.xxhash64(*t.columns).alias("ord"), x0.cast("double").alias("x0"), ((F.col("l_orderkey") * 6007 + F.col("l_linenumber") * 97) % 30000).cast("double").alias("y0"), w.alias("w"))
    rows = rows.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("w") * 0.75})
    return rows.select("sample_id").distinct(), rows.filter("not is_object"), rows.filter("is_object")


@query(f"WITH {_CROWD}, s AS (SELECT sample_id, count(*) FILTER (WHERE role = 'worker') AS subjects, count(*) FILTER (WHERE role = 'object') AS refs FROM crowd GROUP BY 1), "
       f"b AS (SELECT w.sample_id, count(*) AS bare FROM crowd w WHERE role = 'worker' AND NOT EXISTS (SELECT 1 FROM crowd o WHERE o.sample_id = w.sample_id AND o.role = 'object' AND {a.near_sql('w', 'o', '25')}) GROUP BY 1) "
       "SELECT sample_id, subjects, refs AS \"references\", coalesce(bare, 0) AS bare, CASE WHEN subjects = 0 THEN CASE WHEN refs > 0 THEN 'compliant' ELSE 'violation' END WHEN coalesce(bare, 0) = 0 THEN 'compliant' ELSE 'violation' END AS answer, CASE WHEN coalesce(bare, 0) < subjects THEN 'hazard' ELSE 'safe' END AS proximity FROM s LEFT JOIN b USING (sample_id)")
def crowded_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return near.coverage(*_crowd(spark, sf), 25.0)


@query(f"WITH {_CROWD} SELECT w.sample_id, count(*) AS pairs FROM crowd w JOIN crowd o USING (sample_id) WHERE w.role = 'worker' AND o.role = 'object' AND {a.near_sql('w', 'o', '2')} GROUP BY 1")
def crowded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    _, workers, objects = _crowd(spark, sf)
    return near.pair_counts(workers, objects, 2.0)


_LIMIT = "CASE assigned_rule_id WHEN 'rule_1' THEN 0.08 WHEN 'rule_2' THEN 0.08 WHEN 'rule_3' THEN 0.2 ELSE 0.05 END * 640"


@query(f"""WITH {a.SAMPLES}, {a.BOXES}, s AS (SELECT sample_id, assigned_rule_id, {_LIMIT} AS lim FROM samples),
w AS (SELECT w.sample_id, w.ord, bool_or(o.ord IS NOT NULL AND {a.near_sql('w', 'o', 's.lim')}) AS near FROM boxes w JOIN s USING (sample_id) LEFT JOIN boxes o ON o.sample_id = w.sample_id AND o.role = 'object' WHERE w.role = 'worker' GROUP BY ALL),
x AS (SELECT sample_id, bool_and(near) AS all_near, bool_or(near) AS any_near FROM w GROUP BY 1), o AS (SELECT sample_id, count(*) AS n FROM boxes WHERE role = 'object' GROUP BY 1)
SELECT s.sample_id, s.assigned_rule_id, CASE WHEN assigned_rule_id = 'rule_4' THEN CASE WHEN coalesce(any_near, false) THEN 'hazard' ELSE 'safe' END
 WHEN all_near IS NULL THEN CASE WHEN o.n > 0 THEN 'compliant' ELSE 'violation' END WHEN all_near THEN 'compliant' ELSE 'violation' END AS answer FROM s LEFT JOIN x USING (sample_id) LEFT JOIN o USING (sample_id)""")
def answer_rule(spark: SparkSession, sf: str) -> DataFrame:
    rows = decide.in_row(a.samples(spark, sf), a.boxes(spark, sf))
    return rows.select("sample_id", "assigned_rule_id", decide.answer(F.col("assigned_rule_id"), F.col("workers"), F.col("objects"), F.lit(a.WIDTH), F.lit(a.HEIGHT)).alias("answer"))


@query("""WITH x AS (SELECT vec_id, label, (vec_id % 3) AS step, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings),
p AS (SELECT label, step, 1 / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) AS p FROM x), s AS (SELECT label, step, avg(p) AS p FROM p GROUP BY ALL)
SELECT label, round(avg(p), 6) AS confidence FROM s GROUP BY 1""")
def detection_confidence(spark: SparkSession, sf: str) -> DataFrame:
    steps = a.heatmaps(spark, sf).select("label", (F.col("vec_id") % 3).alias("step"), F.col("vec_id").alias("beam"), F.col("raw").alias("logits"))
    return decide.detection_confidence(steps, ["label"]).select("label", _r(F.col("confidence")).alias("confidence"))


# Samples


@query(f"WITH {a.SAMPLES} SELECT image_id, primary_class, violated AS violated_rules, assigned_rule_id FROM samples")
def classify_samples(spark: SparkSession, sf: str) -> DataFrame:
    return a.samples(spark, sf).select("image_id", "primary_class", labels.piped(F.col("violated_rules")).alias("violated_rules"), "assigned_rule_id")


@query(f"""WITH {a.SAMPLES}, pool AS (SELECT *, row_number() OVER (PARTITION BY primary_class ORDER BY sample_id, image_id) AS pos FROM samples QUALIFY pos <= 500),
d AS (SELECT *, row_number() OVER (PARTITION BY primary_class ORDER BY md5(image_id || '#42'), image_id) AS rn FROM pool QUALIFY rn <= 50)
SELECT image_id, primary_class, CASE WHEN primary_class = 'compliant' THEN 'rule_' || ((rn - 1) % 4 + 1) ELSE assigned_rule_id END AS assigned_rule_id FROM d""")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    drawn = sampling.balanced_sample(a.samples(spark, sf).drop("assigned_rule_id"), 50, 42, F.col("sample_id"))
    return drawn.select("image_id", "primary_class", "assigned_rule_id")


@query(f"WITH {a.SAMPLES}, c AS (SELECT unnest(['ppe_violation', 'fall_hazard', 'struck_by_risk', 'compliant']) AS primary_class) SELECT primary_class, count(sample_id) AS n FROM c LEFT JOIN samples USING (primary_class) GROUP BY 1")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.class_counts(a.samples(spark, sf))


@query(f"WITH {a.SAMPLES}, c AS (SELECT unnest(['ppe_violation', 'fall_hazard', 'struck_by_risk', 'compliant']) AS primary_class) SELECT primary_class, count(sample_id) AS n FROM c LEFT JOIN samples USING (primary_class) GROUP BY 1 HAVING count(sample_id) < 3000")
def underfilled_classes(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.underfilled(a.samples(spark, sf), 3000)


# Joins


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_target(spark: SparkSession, sf: str) -> DataFrame:
    keys = a.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return relational.semi(a.table(spark, sf, "orders"), keys, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    found = a.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.missing(a.table(spark, sf, "orders").select("o_orderkey"), found, ["o_orderkey"])


@query("SELECT l.l_partkey, l.l_suppkey, count(*) AS n, round(sum(l.l_extendedprice), 2) AS price FROM lineitem l JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') r ON l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey GROUP BY ALL")
def join_two_key(spark: SparkSession, sf: str) -> DataFrame:
    t = a.table(spark, sf, "lineitem")
    keys = t.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return t.join(keys, ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT r_name, c_mktsegment, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_four_way(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (a.table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("SELECT d.doc_id, l.quality, CASE WHEN l.quality IS NULL THEN 'not_labelled' WHEN l.toxic = 1 THEN 'toxic' END AS excluded_reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_left(spark: SparkSession, sf: str) -> DataFrame:
    joined = a.table(spark, sf, "documents").select("doc_id").join(a.table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", "quality", F.when(F.col("quality").isNull(), "not_labelled").when(F.col("toxic") == 1, "toxic").alias("excluded_reason"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return relational.first_by(a.table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT o_orderkey, p.perturbation, o_orderkey % 2 = 0 AS even FROM orders, (VALUES ('blur'), ('low_light'), ('occlude'), ('contrast_shift')) p(perturbation)")
def sample_x_perturbation(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2 == 0).alias("even"))
    return relational.cross_with(rows, list(images.PERTURBATIONS), "perturbation")


# Sparsity

_MAPS = f"WITH {a.HEATMAPS}, n AS (SELECT vec_id, label, {a.MIN_MAX} AS c FROM maps)"


@query(f"{_MAPS} SELECT vec_id, round(list_sum(list_reverse_sort(c)[1:5]) / list_sum(c), 6) AS top5, round(list_sum(list_reverse_sort(c)[1:20]) / list_sum(c), 6) AS top20 FROM n")
def topk_mass_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.heatmaps(spark, sf).withColumn("c", h.min_max(F.col("raw")))
    return rows.select("vec_id", _r(h.top_mass_ratio(F.col("c"), 5)).alias("top5"), _r(h.top_mass_ratio(F.col("c"), 20)).alias("top20"))


@query(f"{_MAPS} SELECT vec_id, len(list_filter(c, lambda x: x >= 0.5)) AS cells FROM n")
def cells_above_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return a.heatmaps(spark, sf).select("vec_id", h.count_above(h.min_max(F.col("raw"))).cast("long").alias("cells"))


_SLICED = f"WITH {a.HEATMAPS}, t AS (SELECT vec_id, label, raw[2:] AS raw FROM maps), n AS (SELECT vec_id, label, {a.MIN_MAX} AS c FROM t)"


@query(f"{_SLICED}, u AS (SELECT vec_id, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM n) SELECT vec_id, i, round(v, 6) AS v FROM u")
def minmax_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    cells = a.heatmaps(spark, sf).select("vec_id", F.posexplode(h.normalised(F.col("raw"))).alias("i", "v"))
    return cells.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), _r(F.col("v")).alias("v"))


@query(f"""WITH {a.HEATMAPS}, e AS (SELECT label, vec_id % 3 AS step, unnest(raw) AS v, generate_subscripts(raw, 1) AS i FROM maps),
s AS (SELECT label, step, i, avg(v) AS v FROM e GROUP BY ALL), m AS (SELECT label, i, avg(v) AS v, count(*) AS steps FROM s GROUP BY ALL),
k AS (SELECT *, max(v) OVER w - min(v) OVER w AS span, min(v) OVER w AS low FROM m WHERE i BETWEEN 2 AND 50 WINDOW w AS (PARTITION BY label))
SELECT label, i - 1 AS cell, round(CASE WHEN span > 0 THEN (v - low) / span ELSE 0.0 END, 6) AS v, steps AS n_generated_tokens FROM k""")
def attention_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.heatmaps(spark, sf).select("label", (F.col("vec_id") % 3).alias("step"), F.col("raw").alias("weights"))
    maps = attribution.heat_maps(rows.select("label").distinct(), rows, ["label"], 49)
    cells = maps.select("label", "n_generated_tokens", F.posexplode("heatmap").alias("i", "v"))
    return cells.select("label", (F.col("i") + 1).cast("long").alias("cell"), _r(F.col("v")).alias("v"), F.col("n_generated_tokens").cast("long").alias("n_generated_tokens"))


@query(f"""{_MAPS} SELECT vec_id, CASE WHEN label = 0 THEN 0 ELSE vec_id % 5 + 1 END AS n_generated_tokens, CASE WHEN label = 0 THEN NULL ELSE round(list_sum(list_reverse_sort(c)[1:5]) / list_sum(c), 6) END AS top5,
CASE WHEN label = 0 THEN NULL ELSE round(list_sum(list_reverse_sort(c)[1:20]) / list_sum(c), 6) END AS top20, CASE WHEN label = 0 THEN NULL ELSE len(list_filter(c, lambda x: x >= 0.5))::DOUBLE END AS cells, CASE WHEN label = 0 THEN 'grid_fallback_no_box' END AS excluded_reason FROM n""")
def sparsity_excluded(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.heatmaps(spark, sf).withColumn("source", F.when(F.col("label") == 0, "grid").otherwise("model"))
    found = rows.select("vec_id", *h.scored(F.col("source"), h.min_max(F.col("raw")), F.col("vec_id") % 5 + 1))
    return found.select("vec_id", F.col("n_generated_tokens").cast("long").alias("n_generated_tokens"), _r(F.col("topk5_mass_ratio")).alias("top5"), _r(F.col("topk20_mass_ratio")).alias("top20"), F.col("`regions_above_0.5`").alias("cells"), "excluded_reason")


# Stability


@query(f"WITH {a.runs_sql()} SELECT x.sample_id, count(DISTINCT x.run) AS runs, round(avg((x.answer = y.answer)::INT) FILTER (WHERE x.run < y.run), 6) AS agreement_rate FROM runs x JOIN runs y ON x.sample_id = y.sample_id GROUP BY 1")
def answer_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.agreement(a.runs(spark, sf), ["sample_id"]).select("sample_id", "runs", _r(F.col("agreement_rate")).alias("agreement_rate"))


@query(f"WITH {a.runs_sql(7)}, c AS (SELECT sample_id, answer, count(*) AS n FROM runs GROUP BY ALL), m AS (SELECT sample_id, answer AS majority_answer FROM c QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, answer) = 1) "
       "SELECT m.sample_id, majority_answer, r.answer = majority_answer AS deterministic_matches FROM m JOIN runs r ON r.sample_id = m.sample_id AND r.run = 1")
def majority_answer(spark: SparkSession, sf: str) -> DataFrame:
    runs = a.runs(spark, sf, 7)
    found = metrics.majority(runs, ["sample_id"]).join(runs.filter("run = 1"), "sample_id")
    return found.select("sample_id", "majority_answer", (F.col("answer") == F.col("majority_answer")).alias("deterministic_matches"))


def _overlap_sql(guard: str) -> str:
    return f"WITH {a.runs_sql()}, b AS (SELECT sample_id, {guard} OR count(*) < 2 AS bad FROM runs GROUP BY 1), p AS (SELECT x.sample_id, avg({a.iou_sql('x', 'y')}) AS s FROM runs x JOIN runs y ON x.sample_id = y.sample_id AND x.run < y.run GROUP BY 1) SELECT b.sample_id, CASE WHEN bad THEN NULL ELSE round(s, 6) END AS overlap_score FROM b LEFT JOIN p USING (sample_id)"


@query(_overlap_sql("bool_or(source = 'grid')"))
def region_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.overlap(a.runs(spark, sf), ["sample_id"]).select("sample_id", _r(F.col("overlap_score")).alias("overlap_score"))


@query(_overlap_sql("bool_or(value < 2)"))
def object_overlap(spark: SparkSession, sf: str) -> DataFrame:
    runs = a.runs(spark, sf).withColumn("box", F.when(F.col("value") >= 2, F.col("box")))
    return metrics.overlap(runs, ["sample_id"], source=None).select("sample_id", _r(F.col("overlap_score")).alias("overlap_score"))


# Descriptive accuracy, robustness and completeness: answers with the largest boxes masked


def _accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with no, one and two boxes masked."""
    rows = a.answers(spark, sf)
    base, one, two = (F.col(f"top_{k}") for k in a.MASKS)
    confidence = lambda x: F.when(x["answer"] == "compliant", 0.9).otherwise(0.6)
    c1, d1 = metrics.answer_change(base["answer"], confidence(base), one["answer"], confidence(one))
    last = F.when(F.col("n_regions") >= 2, two["answer"]).otherwise(one["answer"])
    return rows.select(
        "sample_id", "image_id", "primary_class", "assigned_rule_id", "violated_rules", "o_totalprice", base["answer"].alias("base"), "n_regions", "top_is_worker", base["workers"].alias("workers"),
        ((base["workers"] > 0) & (one["workers"] == 0)).alias("worker_lost"), F.when(F.col("n_regions") == 0, "grid").otherwise("model").alias("source"),
        c1.alias("changed_1"), (base["answer"] != last).alias("changed_2"), d1.alias("drop_1"), *(F.col(f"lost_{p}.answer").alias(f"lost_{p}") for p in a.LOSSES),
    )


_ACCURACY = f"""WITH {a.SAMPLES}, {a.RANKED}, {a.answer_sql('a0', 0)}, {a.answer_sql('a1', 1)}, {a.answer_sql('a2', 2)}, n AS (SELECT sample_id, count(*) AS n FROM boxes GROUP BY 1),
acc AS (SELECT s.*, a0.answer AS base, coalesce(n.n, 0) AS n_regions, CASE WHEN n.n IS NULL THEN 'grid' ELSE 'model' END AS source, a0.answer <> a1.answer AS changed_1, CASE WHEN n.n >= 2 THEN a0.answer <> a2.answer ELSE a0.answer <> a1.answer END AS changed_2,
  CASE WHEN a0.answer = 'compliant' THEN 0.9 ELSE 0.6 END::DOUBLE - CASE WHEN a1.answer = 'compliant' THEN 0.9 ELSE 0.6 END::DOUBLE AS drop_1, a0.workers > 0 AND a1.workers = 0 AS worker_lost
  FROM samples s JOIN a0 USING (sample_id) JOIN a1 USING (sample_id) JOIN a2 USING (sample_id) LEFT JOIN n USING (sample_id)),
v AS (SELECT *, CASE WHEN source = 'grid' THEN 'no_usable_explanation' WHEN changed_1 OR changed_2 THEN 'explanation_supported' ELSE 'explanation_weak' END AS verdict FROM acc)"""


@query(f"{_ACCURACY} SELECT image_id, base AS baseline_answer, n_regions, changed_1, changed_2, round(drop_1, 6) AS drop_1 FROM acc")
def descriptive_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _accuracy(spark, sf).select("image_id", F.col("base").alias("baseline_answer"), "n_regions", "changed_1", "changed_2", _r(F.col("drop_1")).alias("drop_1"))


@query(f"{_ACCURACY} SELECT count(*) FILTER (WHERE changed_1 AND NOT changed_2) AS unflipped, count(*) AS n FROM acc")
def unflip(spark: SparkSession, sf: str) -> DataFrame:
    return _accuracy(spark, sf).agg(F.count_if(metrics.unflipped(F.col("changed_1"), F.col("changed_2"))).alias("unflipped"), F.count("*").alias("n"))


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _accuracy(spark, sf)
    return rows.withColumn("verdict", labels.verdict(F.col("source"), F.col("changed_1"), F.col("changed_2")))


@query(f"{_ACCURACY} SELECT image_id, verdict, contains(violated, '|') AS is_multi_rule_violation FROM v")
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf).select("image_id", "verdict", labels.is_multi(labels.piped(F.col("violated_rules"))).alias("is_multi_rule_violation"))


@query(f"{_ACCURACY} SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY 1")
def verdict_share(spark: SparkSession, sf: str) -> DataFrame:
    return relational.shares(_verdicts(spark, sf), "verdict").select("verdict", "n", _r(F.col("share")).alias("share"))


@query(f"{_ACCURACY} SELECT assigned_rule_id, count(*) FILTER (WHERE verdict = 'explanation_supported') AS explanation_supported, count(*) FILTER (WHERE verdict = 'explanation_weak') AS explanation_weak, count(*) FILTER (WHERE verdict = 'no_usable_explanation') AS no_usable_explanation FROM v GROUP BY 1")
def verdict_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return relational.crosstab(_verdicts(spark, sf), "assigned_rule_id", "verdict", ["explanation_supported", "explanation_weak", "no_usable_explanation"])


@query(f"{_ACCURACY}, m AS (SELECT verdict FROM v WHERE contains(violated, '|')) SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY 1")
def hard_subset(spark: SparkSession, sf: str) -> DataFrame:
    return relational.shares(_verdicts(spark, sf).filter(F.size("violated_rules") > 1), "verdict").select("verdict", "n", _r(F.col("share")).alias("share"))


def _by_class(value: str, counted: str = "*", times: int = 1) -> str:
    cls = ", ".join(f"avg({value}) FILTER (WHERE primary_class = '{c}') AS {c}" for c in rules.CLASSES)
    return f"avg({value}) AS overall, {cls}, {times} * count({counted}) AS n"


@query(f"{_ACCURACY}, r AS (SELECT {_by_class('changed_1::INT')} FROM acc) SELECT round(overall, 6) AS overall, round(ppe_violation, 6) AS ppe_violation, round(fall_hazard, 6) AS fall_hazard, round(struck_by_risk, 6) AS struck_by_risk, round(compliant, 6) AS compliant, n FROM r")
def rate_by_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = _accuracy(spark, sf)
    found = rows.agg(*relational.rate_by_class(rows, F.col("changed_1")))
    return found.select(*(_r(F.col(c)).alias(c) for c in ("overall", *rules.CLASSES)), "n")


@query(f"""{_ACCURACY}, g AS (SELECT CASE grouping(primary_class, assigned_rule_id) WHEN 0 THEN 'class_rule' WHEN 1 THEN 'class' WHEN 2 THEN 'rule' ELSE 'overall' END AS level, primary_class AS class, assigned_rule_id AS rule, round(avg(changed_1::INT), 6) AS rate, count(*) AS n
  FROM acc GROUP BY GROUPING SETS ((), (primary_class), (assigned_rule_id), (primary_class, assigned_rule_id)))
SELECT * FROM g UNION ALL SELECT 'class', c, NULL, NULL, 0 FROM (SELECT unnest(['ppe_violation', 'fall_hazard', 'struck_by_risk', 'compliant']) AS c) WHERE c NOT IN (SELECT primary_class FROM acc)""")
def rates_long(spark: SparkSession, sf: str) -> DataFrame:
    found = relational.rates_long(_accuracy(spark, sf), F.col("changed_1"))
    return found.select("level", "class", "rule", _r(F.col("rate")).alias("rate"), "n")


_SURVIVAL = ", ".join(a.answer_sql(f"p{p}", kept=f"({{t}}ord + {p}) % 4 <> 0") for p in range(4))
_HALF = "x AS (SELECT sample_id, avg((x.answer = y.answer)::INT) FILTER (WHERE x.run < y.run) AS agreement, 1 AS k FROM runs x JOIN runs y USING (sample_id) GROUP BY 1)"


@query(f"""{_ACCURACY}, {_SURVIVAL}, {a.HEATMAPS}, mm AS (SELECT vec_id, {a.MIN_MAX} AS c FROM maps), t AS (SELECT vec_id, list_sum(list_reverse_sort(c)[1:5]) / list_sum(c) AS top5 FROM mm), {a.runs_sql()}, {_HALF},
w AS (SELECT v.*, CASE WHEN source = 'model' THEN t.top5 END AS top5, x.agreement, x.k, ((p0.answer = base)::INT + (p1.answer = base)::INT + (p2.answer = base)::INT + (p3.answer = base)::INT) / 4.0 AS survival
  FROM v JOIN p0 USING (sample_id) JOIN p1 USING (sample_id) JOIN p2 USING (sample_id) JOIN p3 USING (sample_id) LEFT JOIN t ON t.vec_id = sample_id % (SELECT count(*) FROM embeddings) LEFT JOIN x USING (sample_id)),
r AS (SELECT 'descriptive_accuracy' AS metric, {_by_class('changed_1::INT', 'changed_1')} FROM w UNION ALL SELECT 'visual_sparsity_top5', {_by_class('top5', "CASE WHEN source = 'model' THEN 1 END")} FROM w
UNION ALL SELECT 'stability_answer_agreement', {_by_class('agreement', 'k')} FROM w UNION ALL SELECT 'robustness_level1_answer_survival', {_by_class('survival', 'survival', 4)} FROM w
UNION ALL SELECT 'bounded_completeness', {_by_class("(verdict = 'explanation_supported')::INT", 'verdict')} FROM w),
h AS (SELECT 'efficiency_total_pipeline_1000hr' AS metric, sum(m) AS overall FROM (SELECT avg(value) * 1000 / 1000.0 / 3600 AS m FROM events GROUP BY event_type))
SELECT metric, 'higher_better' AS direction, round(overall, 6) AS overall, round(compliant, 6) AS compliant, round(ppe_violation, 6) AS ppe_violation, round(fall_hazard, 6) AS fall_hazard, round(struck_by_risk, 6) AS struck_by_risk, n::VARCHAR AS n,
  CASE metric WHEN 'descriptive_accuracy' THEN 'descriptive_accuracy.csv' WHEN 'visual_sparsity_top5' THEN 'visual_sparsity.csv' WHEN 'stability_answer_agreement' THEN 'stability.csv' WHEN 'bounded_completeness' THEN 'bounded_completeness.csv' ELSE 'robustness.csv' END AS source_csv FROM r
UNION ALL SELECT metric, 'lower_better', round(overall, 6), NULL, NULL, NULL, NULL, 'n/a -- aggregate runtime budget, not a per-sample classification', 'efficiency_summary.csv' FROM h""")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    maps = a.heatmaps(spark, sf)
    top = maps.select(F.col("vec_id").alias("slot"), h.top_mass_ratio(h.min_max(F.col("raw")), 5).alias("top5"))
    agreed = metrics.agreement(a.runs(spark, sf), ["sample_id"]).select("sample_id", "agreement_rate", F.lit(1).alias("sampled"))
    rows = _verdicts(spark, sf).join(top, F.col("sample_id") % maps.count() == F.col("slot"), "left").join(agreed, "sample_id", "left")
    survived = sum(((F.col(f"lost_{p}") == F.col("base")).cast("double") for p in a.LOSSES), F.lit(0.0)) / 4
    one = F.lit(1)
    hours = a.table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("ms")).select(metrics.extrapolate(F.col("ms"), 1000)[2]).agg(F.sum("hours").alias("hours"))
    found = metrics.summary(
        rows,
        {
            "descriptive_accuracy": (F.col("changed_1"), one),
            "visual_sparsity_top5": (F.col("top5"), F.when(F.col("source") == "model", 1)),
            "stability_answer_agreement": (F.col("agreement_rate"), F.col("sampled")),
            "robustness_level1_answer_survival": (survived, F.lit(4)),
            "bounded_completeness": (F.col("verdict") == "explanation_supported", one),
        },
        hours,
    )
    return found.select("metric", "direction", *(_r(F.col(c)).alias(c) for c in ("overall", "compliant", "ppe_violation", "fall_hazard", "struck_by_risk")), "n", "source_csv")


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """The answers without the one and two largest boxes against the answer with all, from one grouping."""

    def at(k: int) -> Column:
        x = F.col(f"top_{k}")
        return F.struct(x["answer"].alias("answer"), (F.lit(0.9) - x["workers"] / 100.0).alias("confidence"), x["workers"].alias("workers"), x["object"].alias("object"))

    rows = a.answers(spark, sf).select("sample_id", at(0).alias("b"), F.explode(F.array(*(F.struct(F.lit(f"top_{k}").alias("perturbation"), at(k).alias("v")) for k in (1, 2)))).alias("x"))
    return rows.select("sample_id", "x.perturbation", *metrics.compared(F.col("b"), F.col("x.v")))


_VARIANTS = f"""WITH {a.RANKED}, {a.answer_sql('a0', 0)}, {a.answer_sql('a1', 1)}, {a.answer_sql('a2', 2)},
x AS (SELECT *, 'top_1' AS perturbation, 1 AS k FROM a1 UNION ALL SELECT *, 'top_2', 2 FROM a2),
f AS (SELECT k.k, sample_id, x0, y0, x1, y1 FROM ranked, (VALUES (0), (1), (2)) k(k) WHERE role = 'object' AND rank > k.k QUALIFY row_number() OVER (PARTITION BY k.k, sample_id ORDER BY ord) = 1),
r AS (SELECT x.sample_id, x.perturbation, a0.answer <> x.answer AS answer_changed, (0.9::DOUBLE - a0.workers / 100) - (0.9::DOUBLE - x.workers / 100) AS confidence_drop,
  CASE WHEN p.sample_id IS NULL OR q.sample_id IS NULL THEN NULL ELSE {a.iou_sql('p', 'q')} END AS object_box_iou, a0.workers > 0 AND x.workers = 0 AS worker_lost
  FROM x JOIN a0 USING (sample_id) LEFT JOIN f p ON p.sample_id = x.sample_id AND p.k = 0 LEFT JOIN f q ON q.sample_id = x.sample_id AND q.k = x.k)"""


@query(f"{_VARIANTS} SELECT sample_id, perturbation, answer_changed, round(confidence_drop, 6) AS confidence_drop, round(object_box_iou, 6) AS object_box_iou, worker_lost FROM r")
def robustness_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _variants(spark, sf).select("sample_id", "perturbation", "answer_changed", _r(F.col("confidence_drop")).alias("confidence_drop"), _r(F.col("object_box_iou")).alias("object_box_iou"), "worker_lost")


@query(f"{_VARIANTS} SELECT perturbation, round(avg(answer_changed::INT), 6) AS change_rate, round(avg(worker_lost::INT), 6) AS lost_rate, round(avg(object_box_iou), 6) AS mean_iou, round(avg(confidence_drop), 6) AS mean_confidence_drop, count(*) AS n FROM r GROUP BY 1")
def robustness_rates(spark: SparkSession, sf: str) -> DataFrame:
    means = {"change_rate": "answer_changed", "lost_rate": "worker_lost", "mean_iou": "object_box_iou", "mean_confidence_drop": "confidence_drop"}
    return _variants(spark, sf).groupBy("perturbation").agg(*(_r(relational.rate(F.col(c))).alias(k) for k, c in means.items()), F.count("*").alias("n"))


@query(f"{_VARIANTS} SELECT count(*) AS n, round(avg((NOT answer_changed AND coalesce(object_box_iou < 0.3, false))::INT), 6) AS rate FROM r WHERE NOT answer_changed")
def stable_but_moved(spark: SparkSession, sf: str) -> DataFrame:
    rows = _variants(spark, sf).filter(~F.col("answer_changed"))
    return rows.agg(F.count("*").alias("n"), _r(relational.rate(F.coalesce(F.col("object_box_iou") < 0.3, F.lit(False)))).alias("rate"))


def _patched(spark: SparkSession, sf: str) -> DataFrame:
    """The patch test's candidates with their answers before and, as recorded under a perturbation, after."""
    found = metrics.patch_candidates(_accuracy(spark, sf), F.col("workers"), [F.col("image_id")])
    return found.withColumn("flip", metrics.patch_flip(F.col("base"), F.col("lost_1")))


_CANDIDATES = f"""{_ACCURACY}, {a.answer_sql('p1', kept='({t}ord + 1) % 4 <> 0')}, cand AS (SELECT acc.*, p1.answer AS patched, base = 'violation' AND p1.answer = 'compliant' AS flip FROM acc JOIN a0 USING (sample_id) JOIN p1 USING (sample_id)
  WHERE primary_class = 'ppe_violation' AND assigned_rule_id = 'rule_1' AND a0.workers > 0 ORDER BY image_id LIMIT 20)"""


@query(f"{_ACCURACY}, p AS (SELECT base, base = 'violation' AND changed_1 AS flip FROM acc) SELECT round(avg(flip::INT), 6) AS naive_rate, round(avg(flip::INT) FILTER (WHERE base = 'violation'), 6) AS eligible_rate, count(*) AS n, count(*) FILTER (WHERE base = 'violation') AS n_eligible FROM p")
def flip_rate_corrected(spark: SparkSession, sf: str) -> DataFrame:
    rows = _accuracy(spark, sf).withColumn("patched", F.when(F.col("changed_1"), F.when(F.col("base") == "violation", "compliant").otherwise("violation")).otherwise(F.col("base")))
    found = rows.agg(*relational.corrected_rate(metrics.patch_flip(F.col("base"), F.col("patched")), F.col("base") == "violation"))
    return found.select(_r(F.col("naive_rate")).alias("naive_rate"), _r(F.col("eligible_rate")).alias("eligible_rate"), "n", "n_eligible")


@query(f"""{_CANDIDATES}, f AS (SELECT cand.*, x1 - x0 AS w, y1 - y0 AS h, x0, y0 FROM cand JOIN boxes USING (sample_id) WHERE ord = 1), b AS (SELECT *, least(w, h * 0.22 * 1.3) AS hw, h * 0.22 AS hh FROM f),
r AS (SELECT *, greatest(round_even((x0 + (w - hw) / 2) / 4, 0), 0) AS l, greatest(round_even(y0 / 4, 0), 0) AS t, least(round_even((x0 + (w - hw) / 2 + hw) / 4, 0), 160) AS rr, least(round_even((y0 + hh) / 4, 0), 120) AS bb FROM b)
SELECT image_id, base AS baseline_answer, patched AS patched_answer, flip AS flipped_to_compliant, (greatest(rr - l, 0) * greatest(bb - t, 0))::BIGINT AS patched_pixels FROM r""")
def patch_stretch(spark: SparkSession, sf: str) -> DataFrame:
    """A hat pasted on the first worker's head in a dark picture of each candidate; its pixels are counted in the picture."""
    first = a.boxes(spark, sf).filter("ord = 1 and role = 'worker'").select("sample_id", g.head(_box()).alias("head"))
    quarter = g.box(*(F.col(f"head.{c}") / 4 for c in ("x0", "y0", "x1", "y1")))
    rows = _patched(spark, sf).join(first, "sample_id").select("image_id", "base", "lost_1", "flip", quarter.alias("box"))
    dark = rows.withColumns({"height": F.lit(120), "width": F.lit(160), "pixels": F.unhex(F.repeat(F.lit("00"), 120 * 160 * 3))})
    pasted = images.paste_patches(dark, images.hard_hat_patch())
    bright = F.regexp_count(F.decode("pixels", "ISO-8859-1"), F.lit("(?s)[\\x80-\\xff].."))  # a pixel of the patch, its red first
    return pasted.select("image_id", F.col("base").alias("baseline_answer"), F.col("lost_1").alias("patched_answer"), F.col("flip").alias("flipped_to_compliant"), bright.cast("long").alias("patched_pixels"))


@query(f"{_ACCURACY} SELECT image_id, assigned_rule_id, CASE WHEN assigned_rule_id <> 'rule_4' THEN changed_1 END AS answer_changed, CASE WHEN assigned_rule_id = 'rule_4' THEN 'rule_4_has_no_second_phrasing' END AS excluded_reason FROM acc")
def prompt_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    reason = metrics.excluded_level_2(F.col("assigned_rule_id"))
    return _accuracy(spark, sf).select("image_id", "assigned_rule_id", F.when(reason.isNull(), F.col("changed_1")).alias("answer_changed"), reason.alias("excluded_reason"))


@query(f"{_ACCURACY} SELECT count(*) FILTER (WHERE verdict = 'explanation_supported' AND worker_lost) AS supported_lost, count(*) FILTER (WHERE verdict = 'explanation_weak' AND worker_lost) AS weak_lost FROM v")
def supported_worker_lost(spark: SparkSession, sf: str) -> DataFrame:
    lost = F.col("worker_lost")
    return _verdicts(spark, sf).agg(F.count_if(lost & (F.col("verdict") == "explanation_supported")).alias("supported_lost"), F.count_if(lost & (F.col("verdict") == "explanation_weak")).alias("weak_lost"))


# Completeness from stored tables: four of them and the masked reruns


def _stored(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables of the earlier stages as they are stored: lists piped or JSON, confidence as text. Only regions lack some samples."""
    rows = tables.stored(_accuracy(spark, sf).select("sample_id", "image_id", "assigned_rule_id", "primary_class", "violated_rules", "o_totalprice", "base", "source", "changed_1", "changed_2"), "accuracy")
    held = tables.stored(_boxes_of(spark, sf), "boxes")
    known = rows.join(held, "sample_id")
    boxes = lambda c: F.to_json(F.transform(c, g.to_list))
    return {
        "accuracy": rows.select("image_id", "assigned_rule_id", "primary_class", F.col("changed_1").alias("answer_changed_top1"), F.col("changed_2").alias("answer_changed_top2")),
        "regions": rows.filter("sample_id % 11 > 0").select("image_id", "assigned_rule_id", F.col("source").alias("top_region_source")),
        "samples": rows.select("image_id", labels.piped(F.col("violated_rules")).alias("violated_rule_ids")),
        "predictions": known.select("image_id", F.col("base").alias("answer"), boxes("workers").alias("worker_boxes"), boxes("objects").alias("object_boxes"), F.lit("0.75").alias("confidence")),
        "quality": rows.filter("sample_id % 5 > 0").select("image_id", F.when(F.col("o_totalprice") < 60000, "poor info").otherwise("rich info").alias("quality_of_info")),
        "masked": known.filter("source = 'model'").select("image_id", F.col("left").alias("workers")),
    }


def _boxes_of(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, workers, objects, and left: the workers without the largest box. Arrays in order; empty ones where there is none."""
    held = F.struct("ord", _box().alias("b"))
    of = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, held))), lambda s: s.b)
    worker = F.col("role") == "worker"
    sides = {"workers": worker, "objects": ~worker, "left": worker & (F.col("rank") > 1)}
    arrays = a.ranked(spark, sf).groupBy("sample_id").agg(*(of(c).alias(k) for k, c in sides.items()))
    none = F.array().cast(f"array<{g.BOX}>")
    return a.samples(spark, sf).select("sample_id").join(arrays, "sample_id", "left").withColumns({c: F.coalesce(c, none) for c in sides})


_COMPLETE = f"""{_ACCURACY}, b AS (SELECT image_id, assigned_rule_id, primary_class, verdict, contains(violated, '|') AS is_multi_rule_violation,
  CASE WHEN sample_id % 5 > 0 THEN CASE WHEN o_totalprice < 60000 THEN 'poor info' ELSE 'rich info' END END AS quality_of_info, source AS top_region_source, CASE WHEN source = 'model' THEN worker_lost END AS worker_lost_in_top1_mask FROM v WHERE sample_id % 11 > 0)"""


@query(f"{_COMPLETE} SELECT * FROM b")
def bounded_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.completeness(**_stored(spark, sf))


@query(f"{_COMPLETE} SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b WHERE quality_of_info = 'poor info' GROUP BY 1")
def poor_info_subset(spark: SparkSession, sf: str) -> DataFrame:
    poor = metrics.completeness(**_stored(spark, sf)).filter("quality_of_info = 'poor info'")
    return relational.shares(poor, "verdict").select("verdict", "n", _r(F.col("share")).alias("share"))


@query(f"{_COMPLETE} SELECT round(avg((top_region_source = 'grid')::INT), 6) AS grid_rate, count(worker_lost_in_top1_mask) AS scored, round(avg(worker_lost_in_top1_mask::INT), 6) AS lost_rate, round(avg(worker_lost_in_top1_mask::INT) FILTER (WHERE verdict = 'explanation_supported'), 6) AS supported_lost_rate FROM b")
def worker_lost_audit(spark: SparkSession, sf: str) -> DataFrame:
    lost = F.col("worker_lost_in_top1_mask")
    rates = {"grid_rate": F.col("top_region_source") == "grid", "lost_rate": lost, "supported_lost_rate": F.when(F.col("verdict") == "explanation_supported", lost)}
    return metrics.completeness(**_stored(spark, sf)).agg(F.count(lost).alias("scored"), *(_r(relational.rate(v)).alias(k) for k, v in rates.items()))


@query(f"WITH {a.RANKED}, {a.answer_sql('base')} SELECT lpad(sample_id::VARCHAR, 7, '0') AS image_id, answer, workers::BIGINT AS workers, round(coalesce(x, 0), 6) AS x, 0.75::DOUBLE AS confidence FROM base LEFT JOIN (SELECT sample_id, sum(x0 + y1) AS x FROM boxes WHERE role = 'object' GROUP BY 1) USING (sample_id)")
def baseline_rehydration(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.rehydrate(_stored(spark, sf)["predictions"])
    return rows.select("image_id", "answer", F.size("workers").cast("long").alias("workers"), _r(F.aggregate("objects", F.lit(0.0), lambda s, b: s + b.x0 + b.y1)).alias("x"), "confidence")


# How sure rates are, and whether attention agrees with boxes: beyond the reference, which only plans them

_TIMES = " + ".join(f"(u >= {t})::INT" for t in intervals.thresholds())


@query(f"""{_ACCURACY}, g AS (SELECT image_id, primary_class, changed_1::INT::DOUBLE AS v, r.d FROM acc, range(25) r(d)), x AS (SELECT *, md5(image_id || '#42#' || d) AS h FROM g),
u AS (SELECT primary_class, d * 8 + i AS r, v, ('0x' || substr(h, (i * 4 + 1)::INT, 4))::INT AS u FROM x, range(8) r(i)), w AS (SELECT primary_class, r, v, {_TIMES} AS w FROM u),
m AS (SELECT primary_class, r, sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL), s AS (SELECT primary_class, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT primary_class, count(*) AS n, round(avg(changed_1::INT), 6) AS estimate, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM acc JOIN s USING (primary_class) GROUP BY 1""")
def rate_intervals(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.bootstrap(_accuracy(spark, sf), F.col("image_id"), "primary_class", F.col("changed_1"), 42)
    return found.select("primary_class", "n", *(_r(F.col(c)).alias(c) for c in ("estimate", "low", "high")))


@query(f"WITH {a.SAMPLES}, l AS (SELECT unnest(string_split(violated, '|')) AS label FROM samples), n AS (SELECT label, count(*) AS n FROM l WHERE label <> '' GROUP BY 1) SELECT label, f.fold::INT AS fold, n AS of_all, true AS near FROM n, range(3) f(fold)")
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Three folds of the samples: near says that a fold has its ratio of a label's rows, give or take one."""
    ratios = [0.7, 0.2, 0.1]
    rows = stratify.split(a.samples(spark, sf), F.col("violated_rules"), F.col("image_id"), ratios, 42)
    found = rows.select("fold", F.explode("violated_rules").alias("label")).groupBy("label").agg(F.count("*").alias("of_all"), *(F.count_if(F.col("fold") == k).alias(f"f{k}") for k in range(3)))
    each = [F.struct(F.lit(k).alias("fold"), (F.abs(F.col(f"f{k}") - r * F.col("of_all")) <= 1.000001).alias("near")) for k, r in enumerate(ratios)]
    return found.select("label", "of_all", F.inline(F.array(*each)))


_LAYER = """l{n} AS (SELECT label, i, j, (w + (i = j)::INT) / sum(w + (i = j)::INT) OVER (PARTITION BY label, i) AS w FROM (SELECT s.label, s.i, s.j, coalesce(m.w, 0) AS w FROM slots s LEFT JOIN m ON m.label = s.label AND m.i = s.i AND m.j = s.j AND m.layer = {n}))"""


@query(f"""WITH {a.HEATMAPS}, e AS (SELECT vec_id, label, unnest(raw) AS v, generate_subscripts(raw, 1) - 1 AS c FROM maps), w AS (SELECT label, vec_id % 3 AS layer, c // 8 AS i, c % 8 AS j, abs(v) / sum(abs(v)) OVER (PARTITION BY vec_id, c // 8) AS w FROM e),
m AS (SELECT label, layer, i, j, avg(w) AS w FROM w GROUP BY ALL), slots AS (SELECT DISTINCT label, i.i, j.j FROM maps, range(8) i(i), range(8) j(j)), {', '.join(_LAYER.format(n=n) for n in range(3))},
p AS (SELECT a.label, a.i, b.j, sum(a.w * b.w) AS w FROM l1 a JOIN l0 b ON a.label = b.label AND a.j = b.i GROUP BY ALL), q AS (SELECT a.label, a.i, b.j, sum(a.w * b.w) AS w FROM l2 a JOIN p b ON a.label = b.label AND a.j = b.i GROUP BY ALL)
SELECT label, i AS token, j AS "from", round(w, 6) AS w FROM q""")
def attention_rollout(spark: SparkSession, sf: str) -> DataFrame:
    """Three layers of eight tokens for each label, the maps being their heads, in blocks of three."""
    at = lambda i: F.transform(F.slice("raw", i * 8 + 1, 8), lambda x: F.abs(x))
    rows = a.heatmaps(spark, sf).select("label", (F.col("vec_id") % 3).alias("layer"), F.posexplode(F.array(*(at(i) for i in range(8)))).alias("row", "w"))
    share = F.transform("w", lambda x: x / h.total(F.col("w")))
    found = rollout.rollout(rows.select("label", "layer", "row", share.alias("weights")), ["label"], 8, 3)
    cells = found.select("label", F.col("row").cast("long").alias("token"), F.posexplode("weights").alias("from", "w"))
    return cells.select("label", "token", F.col("from").cast("long").alias("from"), _r(F.col("w")).alias("w"))


_CHOOSE = "(lgamma({n} + 1.0::DOUBLE) - lgamma({k} + 1.0::DOUBLE) - lgamma({n} - {k} + 1.0::DOUBLE))"


@query(f"""{_ACCURACY}, c AS (SELECT primary_class AS c, count(*) AS n, count(*) FILTER (WHERE changed_1) AS h FROM acc GROUP BY 1), p AS (SELECT a.c AS first, b.c AS second, a.n AS na, b.n AS nb, a.h AS ha, a.h + b.h AS hits, a.n + b.n AS n, a.h / a.n::DOUBLE - b.h / b.n::DOUBLE AS difference FROM c a JOIN c b ON a.c < b.c),
k AS (SELECT *, unnest(range(greatest(0, hits - nb), least(na, hits) + 1)) AS k FROM p), e AS (SELECT *, exp({_CHOOSE.format(n='hits', k='k')} + {_CHOOSE.format(n='(n - hits)', k='(na - k)')} - {_CHOOSE.format(n='n', k='na')}) AS share FROM k)
SELECT first, second, round(any_value(difference), 6) AS difference, round(least(1.0, sum(share) FILTER (WHERE abs(k * n - na * hits) >= abs(ha * n - na * hits))), 6) AS p_value FROM e GROUP BY ALL""")
def class_differences(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.differences(_accuracy(spark, sf), "primary_class", F.col("changed_1"))
    return found.select("first", "second", _r(F.col("difference")).alias("difference"), _r(F.col("p_value")).alias("p_value"))


@query(f"""WITH {a.RANKED}, {a.HEATMAPS}, n AS (SELECT vec_id, {a.MIN_MAX} AS c FROM maps), u AS (SELECT vec_id, unnest(c) AS v, generate_subscripts(c, 1) - 1 AS i, list_position(c, list_max(c)) - 1 AS peak FROM n),
e AS (SELECT vec_id, v, i = peak AS top, ((i % 8) + 0.5::DOUBLE) * 80 AS x, ((i // 8) + 0.5::DOUBLE) * 60 AS y FROM u), t AS (SELECT * FROM ranked WHERE rank = 1)
SELECT sample_id, round(sum(CASE WHEN x >= x0 AND x < x1 AND y >= y0 AND y < y1 THEN v ELSE 0 END) / sum(v), 6) AS mass, bool_or(top AND x >= x0 AND x < x1 AND y >= y0 AND y < y1) AS hit FROM t JOIN e ON vec_id = sample_id % (SELECT count(*) FROM embeddings) GROUP BY 1""")
def attention_in_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each sample's map is in its top region, and whether its peak is."""
    maps = a.heatmaps(spark, sf)
    areas = crossmodal.summed_area(maps.select("vec_id", h.min_max(F.col("raw")).alias("heatmap")), (8, 8))
    rows = a.ranked(spark, sf).filter("rank = 1").drop("area").join(areas, F.col("vec_id") == F.col("sample_id") % maps.count())
    where = (_box(), (8, 8), (a.HEIGHT, a.WIDTH))
    return rows.select("sample_id", _r(crossmodal.mass_in(F.col("area"), *where)).alias("mass"), crossmodal.points_at(F.col("peak"), *where).alias("hit"))


# Efficiency


@query("SELECT event_type AS stage, count(value) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(stddev_pop(value), 6) AS std_ms, max(value) AS max_ms FROM events GROUP BY 1")
def timing_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.timings(a.table(spark, sf, "events").withColumnRenamed("event_type", "stage"), ["stage"], F.col("value"))
    return rows.select("stage", "n", *(_r(F.col(c)).alias(c) for c in ("mean_ms", "median_ms", "std_ms")), "max_ms")


@query(f"WITH {a.RANKED}, n AS (SELECT sample_id, count(*) AS n FROM boxes GROUP BY 1) SELECT n.n >= 2 AS several, count(*) AS samples, sum(CASE WHEN n.n >= 2 THEN 2 ELSE 1 END)::BIGINT AS calls, round(sum(CASE WHEN n.n >= 2 THEN 2 ELSE 1 END * (o_totalprice / 1000)), 3) AS cost_ms FROM n JOIN orders ON o_orderkey = sample_id GROUP BY 1")
def cost_recovery(spark: SparkSession, sf: str) -> DataFrame:
    n = a.boxes(spark, sf).groupBy("sample_id").agg(F.count("*").alias("n"))
    rows = n.join(a.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("sample_id"))
    calls = metrics.reruns(F.col("n"))
    return rows.groupBy((F.col("n") >= 2).alias("several")).agg(F.count("*").alias("samples"), F.sum(calls).alias("calls"), F.round(F.sum(calls * (F.col("o_totalprice") / 1000)), 3).alias("cost_ms"))


@query("SELECT event_type AS stage, round(avg(value) * 1000 / 1000.0, 6) AS seconds, round(avg(value) * 1000 / 1000.0 / 60, 6) AS minutes, round(avg(value) * 1000 / 1000.0 / 3600, 6) AS hours FROM events GROUP BY 1")
def extrapolate(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.avg("value").alias("ms")).select("stage", *metrics.extrapolate(F.col("ms"), 1000))
    return rows.select("stage", *(_r(F.col(c)).alias(c) for c in ("seconds", "minutes", "hours")))


@query("WITH c AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 15), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type AS stage, round(avg(value), 6) AS mean_ms, round(avg(value) * 3, 6) AS mean_ms_per_sample, round(avg(value) * 3 * any_value(n) / 1000, 6) AS total_seconds FROM c JOIN n USING (event_type) GROUP BY 1")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    t = a.table(spark, sf, "events")
    few = metrics.calibration(t, ["event_type"], [F.col("ts"), F.col("event_id")], 15).groupBy("event_type").agg(F.avg("value").alias("ms"))
    rows = few.join(t.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    return rows.select(F.col("event_type").alias("stage"), _r(F.col("ms")).alias("mean_ms"), _r(F.col("ms") * 3).alias("mean_ms_per_sample"), _r(F.col("ms") * 3 * F.col("n") / 1000).alias("total_seconds"))


_STAGES = f"""WITH {a.SAMPLES}, {a.BOXES}, n AS (SELECT sample_id, count(*) AS n FROM boxes GROUP BY 1),
p AS (SELECT image_id, assigned_rule_id, o_totalprice / 1000 AS ms, coalesce(n.n, 16) AS n, n.n IS NULL AS grid, o_totalprice / 700 + 1 AS shown, o_totalprice / 900 + 2 AS rerun FROM samples LEFT JOIN n USING (sample_id)),
q AS (SELECT *, CASE WHEN n >= 2 THEN 2 ELSE 1 END AS calls FROM p), c AS (SELECT * FROM q ORDER BY image_id LIMIT 15),
s AS (SELECT 3 AS day, 'baseline_inference' AS name, 1.0::DOUBLE AS calls, avg(ms) AS per_call, avg(ms) AS per_sample, sum(ms) / 1000 AS total, count(*)::VARCHAR AS n_observed FROM q
UNION ALL SELECT 5, 'descriptive_accuracy_reruns', avg(calls), avg(ms), avg(calls * ms), sum(calls * ms) / 1000, count(*)::VARCHAR FROM q
UNION ALL SELECT 6, 'cross_attention_attribution', 1, avg(shown), avg(shown), avg(shown) * (SELECT count(*) FROM q) / 1000, '15 calibration samples, scaled to ' || (SELECT count(*) FROM q) FROM c WHERE NOT grid
UNION ALL SELECT 7, 'stability_sampled_reruns', 3, avg(rerun), avg(rerun) * 3, avg(rerun) * 3 * (SELECT count(*) FROM q) / 1000, '15 calibration samples, scaled to ' || (SELECT count(*) FROM q) FROM c)"""


@query(f"{_STAGES} SELECT day, name, round(calls, 6) AS calls_per_sample, round(per_call, 6) AS mean_ms_per_call, round(per_sample, 6) AS mean_ms_per_sample, round(total, 4) AS observed_total_seconds, n_observed, round(per_sample / 60, 6) AS extrapolated_1000_minutes, round(per_sample / 3600, 6) AS extrapolated_1000_hours FROM s")
def efficiency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Four stages: two timed on every sample, two on a few of them and scaled."""
    n = a.boxes(spark, sf).groupBy("sample_id").agg(F.count("*").alias("n"))
    rows = a.samples(spark, sf).join(n, "sample_id", "left")
    price = F.col("o_totalprice")
    found = metrics.efficiency(
        rows.select("image_id", "assigned_rule_id", (price / 1000).alias("inference_ms")),
        rows.select("image_id", "assigned_rule_id", F.coalesce("n", F.lit(16)).alias("n_regions"), F.when(F.col("n").isNull(), "grid").otherwise("model").alias("top_region_source")),
        rows.select("image_id", (price / 700 + 1).alias("ms")),
        rows.select("image_id", (price / 900 + 2).alias("ms")),
    )
    rounded = {c: F.round(c, 4 if "total" in c else 6) + F.lit(0.0) for c in found.columns if c not in ("day", "name", "n_observed")}
    return found.withColumns(rounded)


# Findings


@query(f"WITH {a.RANKED} SELECT round(corr(ln(area), o_totalprice), 6) AS r, count(*) AS n FROM ranked JOIN orders ON o_orderkey = sample_id WHERE rank = 1")
def corr_area(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.ranked(spark, sf).filter("rank = 1").join(a.table(spark, sf, "orders"), F.col("o_orderkey") == F.col("sample_id"))
    return rows.agg(_r(F.corr(F.log("area"), F.col("o_totalprice"))).alias("r"), F.count("*").alias("n"))


@query("SELECT round(quantile_cont(abs(value - 100), 0.5), 6) AS median_all, round(quantile_cont(abs(value - 100), 0.75), 6) AS p75_all, round(quantile_cont(abs(value - 100), 0.5) FILTER (WHERE event_type = 'view'), 6) AS median_view, round(quantile_cont(abs(value - 100), 0.75) FILTER (WHERE event_type = 'view'), 6) AS p75_view FROM events")
def confidence_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.explode(F.when(F.col("event_type") == "view", F.array(F.lit("all"), F.lit("view"))).otherwise(F.array(F.lit("all"))))
    rows = a.table(spark, sf, "events").select(groups.alias("g"), F.abs(F.col("value") - 100).alias("x"))
    found = quantiles.exact(rows, ["g"], F.col("x"), {"median": 0.5, "p75": 0.75})  # two rows
    return found.agg(*(F.max(F.when(F.col("g") == k, _r(F.col(q)))).alias(f"{q}_{k}") for k in ("all", "view") for q in ("median", "p75")))


@query(f"WITH {a.SAMPLES}, {a.RANKED}, {a.answer_sql('a0', 0)} SELECT round(avg((answer = 'violation')::INT) FILTER (WHERE primary_class <> 'compliant'), 6) AS sensitivity, round(avg((answer = 'compliant')::INT) FILTER (WHERE primary_class = 'compliant'), 6) AS specificity, count(*) FILTER (WHERE primary_class <> 'compliant') AS positives, count(*) FILTER (WHERE primary_class = 'compliant') AS negatives FROM samples JOIN a0 USING (sample_id) WHERE assigned_rule_id <> 'rule_4'")
def sens_spec(spark: SparkSession, sf: str) -> DataFrame:
    answers = decide.coverage_exploded(a.samples(spark, sf), a.boxes(spark, sf), a.NEAR)
    rows = a.samples(spark, sf).filter("assigned_rule_id != 'rule_4'").join(answers, "sample_id")
    bad = F.col("primary_class") != "compliant"
    return rows.agg(
        _r(relational.rate(F.when(bad, (F.col("answer") == "violation").cast("double")))).alias("sensitivity"),
        _r(relational.rate(F.when(~bad, (F.col("answer") == "compliant").cast("double")))).alias("specificity"),
        F.count_if(bad).alias("positives"),
        F.count_if(~bad).alias("negatives"),
    )


@query(f"{_ACCURACY} SELECT role = 'worker' AS top_is_worker, count(*) FILTER (WHERE verdict = 'explanation_supported') AS supported, count(*) FILTER (WHERE verdict = 'explanation_weak') AS weak FROM v JOIN ranked USING (sample_id) WHERE rank = 1 GROUP BY 1")
def verdict_by_top_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = _verdicts(spark, sf).filter("top_is_worker is not null")
    return rows.groupBy("top_is_worker").agg(F.count_if(F.col("verdict") == "explanation_supported").alias("supported"), F.count_if(F.col("verdict") == "explanation_weak").alias("weak"))


# Text forms


@query(f"WITH {a.BOXES} SELECT sample_id, count(*) AS n, round(sum(x1), 6) AS x1, round(max(y1), 6) AS y1 FROM boxes WHERE role = 'worker' GROUP BY 1")
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = decide.in_row(a.samples(spark, sf).select("sample_id"), a.boxes(spark, sf)).filter(F.size("workers") > 0)
    text = rows.select("sample_id", F.to_json(F.transform("workers", g.to_list)).alias("j"))
    back = text.select("sample_id", F.transform(labels.boxes_json(F.col("j")), g.from_list).alias("b"))
    return back.select("sample_id", F.size("b").cast("long").alias("n"), _r(F.aggregate("b", F.lit(0.0), lambda s, x: s + x.x1)).alias("x1"), _r(F.array_max(F.transform("b", lambda x: x.y1))).alias("y1"))


@query(f"WITH {a.SAMPLES} SELECT image_id, violated AS piped, CASE WHEN violated = '' THEN 0 ELSE len(string_split(violated, '|')) END AS n, contains(violated, '|') AS multi, replace(o_orderpriority, ' ', '_') AS slug FROM samples")
def pipe_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.samples(spark, sf).withColumn("piped", labels.piped(F.col("violated_rules")))
    return rows.select("image_id", "piped", F.size(labels.unpiped(F.col("piped"))).cast("long").alias("n"), labels.is_multi(F.col("piped")).alias("multi"), labels.slug(F.col("o_orderpriority")).alias("slug"))


@query(f"WITH {a.SAMPLES} SELECT image_id, CASE WHEN sample_id % 2 = 0 THEN 'worker' ELSE CASE assigned_rule_id WHEN 'rule_1' THEN 'hard hat' WHEN 'rule_2' THEN 'safety harness' WHEN 'rule_3' THEN 'guardrail' ELSE 'excavator' END END AS phrase, "
       "CASE assigned_rule_id WHEN 'rule_1' THEN 'high-visibility vest' WHEN 'rule_2' THEN 'fall-protection lanyard' WHEN 'rule_3' THEN 'edge protection barrier' END AS reworded FROM samples")
def region_phrase(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.samples(spark, sf)
    label = F.when(F.col("sample_id") % 2 == 0, rules.PERSON).otherwise("other")
    reworded = F.when(F.col("assigned_rule_id") != "rule_4", rules.grounding_query(F.when(F.col("assigned_rule_id") != "rule_4", F.col("assigned_rule_id")), 1))
    return rows.select("image_id", labels.phrase_of(F.col("assigned_rule_id"), label).alias("phrase"), reworded.alias("reworded"))


@query(f"WITH {a.SAMPLES} SELECT image_id, assigned_rule_id || '_violation' AS field, assigned_rule_id AS rule, '<GROUND>' || CASE WHEN sample_id % 3 > 0 THEN o_orderpriority ELSE '' END AS prompt, CASE WHEN sample_id % 4 > 0 THEN (o_totalprice + 0.5) / 2 END AS confidence FROM samples")
def prompt_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.samples(spark, sf).withColumn("field", F.concat("assigned_rule_id", F.lit("_violation")))
    text = F.when(F.col("sample_id") % 3 > 0, F.col("o_orderpriority"))
    pair = decide.run_confidence(F.when(F.col("sample_id") % 4 > 0, F.col("o_totalprice")), F.lit(0.5))
    return rows.select("image_id", "field", labels.short_rule(F.col("field")).alias("rule"), labels.task_prompt(F.lit("<GROUND>"), text).alias("prompt"), pair.alias("confidence"))


@query(f"""WITH {a.SAMPLES} SELECT image_id, 'worker' AS person, CASE assigned_rule_id WHEN 'rule_1' THEN 'hard hat' WHEN 'rule_2' THEN 'safety harness' WHEN 'rule_3' THEN 'guardrail' ELSE 'excavator' END AS first,
CASE assigned_rule_id WHEN 'rule_1' THEN 'high-visibility vest' WHEN 'rule_2' THEN 'fall-protection lanyard' WHEN 'rule_3' THEN 'edge protection barrier' ELSE 'excavator' END AS second FROM samples""")
def answer_phrases(spark: SparkSession, sf: str) -> DataFrame:
    pair = [decide.phrases(F.col("assigned_rule_id"), k) for k in (0, 1)]
    return a.samples(spark, sf).select("image_id", pair[0][0].alias("person"), pair[0][1].alias("first"), pair[1][1].alias("second"))


# Sources and sinks: written to the session's folder and read back


def _written(df: DataFrame, name: str) -> str:
    path = tables.scratch(df.sparkSession, name)
    (tables.write_json if name == "json" else tables.write_csv)(df, path)
    return path


@query("SELECT lpad(c_custkey::VARCHAR, 7, '0') AS image_id, 'rule_1' AS assigned_rule_id, c_mktsegment AS primary_class, '[\"' || c_name || '\", \"x,y\"]' AS sampled_answers, CASE WHEN c_custkey % 3 > 0 THEN round(c_acctbal, 6) END AS answer_agreement_rate, c_custkey % 2 = 0 AS deterministic_matches_majority FROM customer")
def csv_typed(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.table(spark, sf, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("image_id"), F.lit("rule_1").alias("assigned_rule_id"), F.col("c_mktsegment").alias("primary_class"), F.lit("safe").alias("deterministic_answer"),
        F.concat(F.lit('["'), "c_name", F.lit('", "x,y"]')).alias("sampled_answers"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).otherwise(F.lit(float("nan"))).alias("answer_agreement_rate"),
        F.lit("safe").alias("majority_sampled_answer"), (F.col("c_custkey") % 2 == 0).alias("deterministic_matches_majority"), F.lit(None).cast("double").alias("top_region_overlap_score"), F.lit(None).cast("double").alias("object_region_overlap_score"),
    )
    got = tables.read_csv(spark, _written(rows, "stability"), "stability")
    return got.select("image_id", "assigned_rule_id", "primary_class", "sampled_answers", _r(F.col("answer_agreement_rate")).alias("answer_agreement_rate"), "deterministic_matches_majority")


@query(f"WITH {a.SAMPLES} SELECT image_id, violated, CASE WHEN violated = '' THEN 0 ELSE len(string_split(violated, '|')) END AS n, CASE WHEN sample_id % 2 = 0 THEN round(o_totalprice, 6) END AS number FROM samples")
def csv_text(spark: SparkSession, sf: str) -> DataFrame:
    """Lists are piped, every column comes back as text, and what is no number is null."""
    rows = a.samples(spark, sf).select("image_id", F.col("violated_rules").alias("violated"), F.when(F.col("sample_id") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("number"))
    got = tables.read_text_csv(spark, _written(rows, "text"), ["image_id", "violated", "number"])
    text = F.coalesce("violated", F.lit(""))
    return got.select("image_id", text.alias("violated"), F.size(labels.unpiped(text)).cast("long").alias("n"), _r(tables.number(F.col("number"))).alias("number"))


@query(f"WITH {a.SAMPLES} SELECT image_id, list_sort(string_split(violated, '|'))[1] AS first, primary_class FROM samples WHERE violated <> ''")
def json_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = a.samples(spark, sf).filter(F.size("violated_rules") > 0).select("image_id", "violated_rules", "primary_class")
    got = spark.read.schema(rows.schema).json(_written(rows, "json"))
    return got.select("image_id", F.array_sort("violated_rules")[0].alias("first"), "primary_class")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey = 3")
def probe_row(spark: SparkSession, sf: str) -> DataFrame:
    return tables.probe(a.table(spark, sf, "nation").filter("n_nationkey = 3").select("n_name", "n_regionkey"))


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 4")
def figure_budget(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.budget(a.table(spark, sf, "events"), ["event_type"], [F.col("ts"), F.col("event_id")], 4).select("event_type", "event_id")


# Images: small synthetic pictures of 4 x 16 coloured pixels, compared by a digest of all their bytes

_WIDE = 16


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    level = a.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 255), F.lit(256)).cast("int")).alias("v"))
    colours = F.flatten(F.transform("v", lambda x: F.array(x, 255 - x, x * 3 % 256)))
    text = F.unhex(F.array_join(F.transform(colours, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return level.select("vec_id", F.lit(4).alias("height"), F.lit(_WIDE).alias("width"), text.alias("pixels"))


def _digest(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.md5(F.lower(F.hex("pixels")).cast("binary")).alias("digest"))


_PIXELS = """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 255) % 256)::INT) AS v FROM embeddings),
q AS (SELECT vec_id, flatten(list_transform(v, lambda x: [x, 255 - x, x * 3 % 256])) AS c FROM p),
u AS (SELECT vec_id, unnest(c) AS v, generate_subscripts(c, 1) - 1 AS i FROM q), e AS (SELECT vec_id, v, i, i % 3 AS ch, i // 3 % 16 AS x, i // 48 AS y FROM u)"""


def _pixel_sql(value: str, more: str = "", source: str = "e") -> str:
    """The digests of pictures whose bytes are value."""
    return f"{_PIXELS}{more} SELECT vec_id, md5(string_agg(format('{{:02x}}', ({value})::INT), '' ORDER BY i)) AS digest FROM {source} GROUP BY 1"


def _blurred(radius: int, x0: int, y0: int, x1: int, y1: int, source: str = "e") -> str:
    """b2: the pixels of a part of each picture, blurred inside it."""
    reach = 3 * radius
    weight = f"exp(-0.5 * pow({{}} / {radius}.0::DOUBLE, 2))"
    part = f"x BETWEEN {x0} AND {x1} AND y BETWEEN {y0} AND {y1}"
    return f""", part AS (SELECT * FROM {source} WHERE {part}), k AS (SELECT d::INT AS d, {weight.format('d')} / (SELECT sum({weight.format('o')}) FROM range(-{reach}, {reach + 1}) r(o)) AS w FROM range(-{reach}, {reach + 1}) r(d)),
b1 AS (SELECT e.vec_id, e.i, e.ch, e.x, e.y, sum(k.w * o.v) AS v FROM part e, k, part o WHERE o.vec_id = e.vec_id AND o.ch = e.ch AND o.x = e.x AND o.y = least(greatest(e.y + k.d, {y0}), {y1}) GROUP BY ALL),
b2 AS (SELECT e.vec_id, e.i, sum(k.w * o.v) AS v FROM b1 e, k, b1 o WHERE o.vec_id = e.vec_id AND o.ch = e.ch AND o.y = e.y AND o.x = least(greatest(e.x + k.d, {x0}), {x1}) GROUP BY ALL)"""


def _line_sql(name: str, source: int, size: int, kernel: str = "bicubic") -> str:
    """A view o, i, k: what pixel o of a resized line has of pixel i of its source, in 2**-22."""
    weight, reach = {"bicubic": ("CASE WHEN d < 1 THEN (1.5 * d - 2.5) * d * d + 1 WHEN d < 2 THEN (((d - 5) * d + 8) * d - 4) * -0.5 ELSE 0 END", 2), "bilinear": ("greatest(1 - d, 0)", 1)}[kernel]
    return f"""{name}_c AS (SELECT o::INT AS o, (o + 0.5::DOUBLE) * {source} / {size} AS c, greatest({source} / {size}::DOUBLE, 1) AS f FROM range({size}) r(o)),
{name}_d AS (SELECT o, i::INT AS i, abs((i - c + 0.5::DOUBLE) / f)::DOUBLE AS d FROM {name}_c, range({source}) r(i) WHERE i >= floor(greatest(c - {reach} * f + 0.5, 0)) AND i < floor(least(c + {reach} * f + 0.5, {source}))),
{name}_w AS (SELECT o, i, ({weight})::DOUBLE AS w FROM {name}_d), {name} AS (SELECT o, i, trunc(w / sum(w) OVER (PARTITION BY o) * 4194304 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS k FROM {name}_w)"""


def _resized_sql(name: str, source: str, keys: str, size: tuple[int, int], to: tuple[int, int], kernel: str = "bicubic") -> str:
    """A view keys, x, y, v: source (keys, x, y, v; height and width as size) as large as to. Columns first, then rows."""
    level = "least(greatest(floor((sum(k * v) + 2097152) / 4194304::DOUBLE), 0), 255)::INT"
    return f"""{_line_sql(f'{name}_x', size[1], to[1], kernel)}, {_line_sql(f'{name}_y', size[0], to[0], kernel)},
{name}_1 AS (SELECT {keys}, o AS x, y, {level} AS v FROM {source} JOIN {name}_x ON i = x GROUP BY ALL), {name} AS (SELECT {keys}, x, o AS y, {level} AS v FROM {name}_1 JOIN {name}_y ON i = y GROUP BY ALL)"""


def _tall(df: DataFrame) -> DataFrame:
    """The pictures six times one below the other: 24 x 16."""
    return df.withColumns({"pixels": F.concat(*["pixels"] * 6), "height": F.lit(24)})


_TALL = ", h AS (SELECT vec_id, v, ch, x, y + 4 * r AS y, i + 192 * r AS i FROM e, range(6) r(r))"


@query(_pixel_sql("v"))
def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every picture written as a PNG file by the committing sink, listed, read back and decoded."""
    path = tables.scratch(spark, "pictures")
    pictures.write(_pictures(spark, sf).withColumn("image_id", F.col("vec_id").cast("string")), path)
    return _digest(pictures.read(pictures.files(spark, path)).withColumn("vec_id", F.col("image_id").cast("long")))


@query(_pixel_sql("v", ", w AS (SELECT e.* FROM e JOIN embeddings USING (vec_id) WHERE label % 2 = 1)", "w"))
def image_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows with coded images; only those of target ids are read and decoded."""
    path = tables.scratch(spark, "source_rows")
    pictures.coded(_pictures(spark, sf)).write.mode("overwrite").parquet(path)
    targets = a.table(spark, sf, "embeddings").filter("label % 2 = 1").select("vec_id")
    return _digest(pictures.decoded(pictures.scan(spark.read.parquet(path), targets, "vec_id")))


@query(_pixel_sql("trunc(pow(v / 255.0::DOUBLE, 2.5) * 255)"))
def image_low_light(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(images.perturb(_pictures(spark, sf), "low_light"))


@query(_pixel_sql("CASE WHEN x BETWEEN 6 AND 9 THEN 0 ELSE v END"))
def image_occlude(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(images.perturb(_pictures(spark, sf), "quarter", {"quarter": lambda x: images.occlude(x, 0.25)}))


@query(_pixel_sql("round_even(v, 0)", _blurred(8, 0, 0, 15, 3), "b2"))
def image_blur(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(images.perturb(_pictures(spark, sf), "blur"))


@query(_pixel_sql("trunc(least(greatest(g + 0.3::FLOAT * (v::FLOAT - g), 0), 255))", ", l AS (SELECT vec_id, i // 3 AS p, (sum(v * CASE ch WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768) // 65536 AS l FROM e GROUP BY ALL), g AS (SELECT vec_id, floor(avg(l) + 0.5)::FLOAT AS g FROM l GROUP BY 1), f AS (SELECT e.*, g.g FROM e JOIN g USING (vec_id))", "f"))
def image_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(images.perturb(_pictures(spark, sf), "contrast_shift"))


@query(_pixel_sql("coalesce(round_even(b, 0), v)", _blurred(25, 2, 1, 12, 3) + ", m AS (SELECT e.*, b2.v AS b FROM e LEFT JOIN b2 USING (vec_id, i))", "m"))
def image_mask_blur(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(images.perturb(_pictures(spark, sf), "mask", {"mask": lambda x: images.mask_region(x, (1.6, 1.4, 12.7, 9.0), "blur")}))


@query(_pixel_sql("CASE WHEN x BETWEEN 2 AND 8 AND y BETWEEN 1 AND 2 THEN 0 ELSE v END"))
def image_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(images.perturb(_pictures(spark, sf), "mask", {"mask": lambda x: images.mask_region(x, (2.2, 0.8, 9.4, 3.1))}))


def _colours() -> images.Pixels:
    """A patch of many colours, five rows of six."""
    y, x, ch = np.indices((5, 6, 3))
    return ((x * 37 + y * 53 + ch * 71) % 256).astype(np.uint8)


_PATCH = "q0 AS (SELECT x::INT AS x, y::INT AS y, ch::INT AS ch, (x * 37 + y * 53 + ch * 71) % 256 AS v FROM range(6) a(x), range(5) b(y), range(3) c(ch))"
_HAT = "q0 AS (SELECT x::INT AS x, y::INT AS y, ch::INT AS ch, CASE WHEN pow((x - 30) / 28.0::DOUBLE, 2) + pow((y - 28) / 26.0::DOUBLE, 2) <= 1 THEN [255, 210, 0] ELSE [235, 220, 200] END[ch + 1] AS v FROM range(60) a(x), range(60) b(y), range(3) c(ch))"


def _pasted_sql(patch: str, size: tuple[int, int], x0: int, y0: int, x1: int, y1: int) -> str:
    more = f", {patch}, {_resized_sql('q2', 'q0', 'ch', size, (y1 - y0, x1 - x0))}, z AS (SELECT e.* REPLACE (coalesce(q2.v, e.v) AS v) FROM e LEFT JOIN q2 ON q2.x = e.x - {x0} AND q2.y = e.y - {y0} AND q2.ch = e.ch)"
    return _pixel_sql("v", more, "z")


@query(_pasted_sql(_PATCH, (5, 6), 2, 0, 13, 3))
def image_patch(spark: SparkSession, sf: str) -> DataFrame:
    """A patch of many colours, wider and lower than it was."""
    return _digest(images.perturb(_pictures(spark, sf), "patch", {"patch": lambda x: images.paste_patch(x, (2, -0.4, 13, 3.4), _colours())}))


@query(_pasted_sql(_HAT, (60, 60), 5, 0, 14, 4))
def image_hat(spark: SparkSession, sf: str) -> DataFrame:
    """The hard-hat patch, made small."""
    return _digest(images.perturb(_pictures(spark, sf), "patch", {"patch": lambda x: images.paste_patch(x, (5, 0, 14, 4), images.hard_hat_patch())}))


_LETTERS = "t AS (SELECT c::INT + 3 AS x, r::INT + 1 AS y FROM (SELECT unnest(['X.X.XXX', 'X.X..X.', 'XXX..X.', 'X.X..X.', 'X.X.XXX']) AS line, unnest(range(5)) AS r), range(7) c(c) WHERE line[c + 1] = 'X')"
_OUTLINE = "x BETWEEN 1 AND 14 AND y BETWEEN 13 AND 22 AND NOT (x BETWEEN 4 AND 11 AND y BETWEEN 16 AND 19)"


@query(_pixel_sql(f"CASE WHEN ({_OUTLINE}) OR (x, y) IN (SELECT (x, y) FROM t) OR (x >= 12 AND y BETWEEN 2 AND 4) THEN CASE ch WHEN 0 THEN 255 ELSE 0 END ELSE v END", f"{_TALL}, {_LETTERS}", "h"))
def image_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines three pixels wide with a label, one of them partly outside."""
    drawn = lambda x: images.overlay_boxes(x, [(1.9, 13, 14.7, 22.2), (12, 2, 40, 4)], ["hi", None])
    return _digest(images.perturb(_tall(_pictures(spark, sf)), "boxes", {"boxes": drawn}))


_HEAT = f"{_TALL}, {a.HEATMAPS}, n AS (SELECT vec_id, {a.MIN_MAX} AS c FROM maps), n0 AS (SELECT vec_id, unnest(c) AS v, generate_subscripts(c, 1) - 1 AS i FROM n), n1 AS (SELECT vec_id, (i % 8)::INT AS x, (i // 8)::INT AS y, trunc(pow(v, 0.5) * 255)::INT AS v FROM n0)"


@query(_pixel_sql("trunc(v * (1 - 0.5::DOUBLE * (heat / 255.0::DOUBLE)) + CASE ch WHEN 0 THEN 255 ELSE 0 END * (0.5::DOUBLE * (heat / 255.0::DOUBLE)))", f"{_HEAT}, {_resized_sql('n2', 'n1', 'vec_id', (8, 8), (24, 16), 'bilinear')}, w AS (SELECT h.*, n2.v AS heat FROM h JOIN n2 USING (vec_id, x, y))", "w"))
def image_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of 8 x 8 over pictures of 24 x 16."""
    maps = a.heatmaps(spark, sf).select("vec_id", h.min_max(F.col("raw")).alias("heatmap"))
    return _digest(images.overlay_heatmaps(_tall(_pictures(spark, sf)).join(maps, "vec_id"), 8, 8, gamma=0.5))


# Inference boundary


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return a.table(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("image_id"), F.lit(rules.PERSON).alias("phrase"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every picture, asked for red."""
    image = F.struct("height", "width", "pixels").alias("image")
    return _pictures(spark, sf).select(F.col("vec_id").cast("string").alias("image_id"), F.lit("red").alias("phrase"), image)


@query(f"{_PIXELS}, s AS (SELECT vec_id, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b, count(*) AS n FROM e WHERE ch = 0 AND v >= 40 GROUP BY 1) "
       "SELECT p.vec_id::VARCHAR AS image_id, l::DOUBLE AS x0, t::DOUBLE AS y0, r::DOUBLE AS x1, b::DOUBLE AS y1, round(coalesce(n / ((r - l) * (b - t))::DOUBLE, 0), 6) AS confidence FROM p LEFT JOIN s USING (vec_id)")
def infer_colours(spark: SparkSession, sf: str) -> DataFrame:
    """A backend that grounds colours in the pixels, with an option of its own."""
    found = inference.run_task(_asked(spark, sf), inference.ColourBackend, level=40)
    first = F.get("boxes", F.lit(0))
    return found.select("image_id", *(F.get(first, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))), _r(F.col("confidence")).alias("confidence"))


@query(f"{_PIXELS}, r AS (SELECT vec_id, i // 3 AS cell, v::DOUBLE AS v FROM e WHERE ch = 0), k AS (SELECT *, max(v) OVER w - min(v) OVER w AS span, min(v) OVER w AS low FROM r WINDOW w AS (PARTITION BY vec_id)) "
       "SELECT vec_id::VARCHAR AS image_id, cell, round(CASE WHEN span > 0 THEN (v - low) / span ELSE 0.0 END, 6) AS v, 1 AS n_generated_tokens FROM k")
def infer_attention(spark: SparkSession, sf: str) -> DataFrame:
    """A backend's attention as it comes, to heat maps."""
    rows = _asked(spark, sf)
    maps = attribution.heat_maps(rows, inference.attention(rows, inference.ColourBackend), ["image_id", "phrase"], 64)
    cells = maps.select("image_id", F.posexplode("heatmap").alias("cell", "v"), F.col("n_generated_tokens").cast("long").alias("n_generated_tokens"))
    return cells.select("image_id", F.col("cell").cast("long").alias("cell"), _r(F.col("v")).alias("v"), "n_generated_tokens")


@query(f"WITH {a.runs_sql()} SELECT lpad(c_custkey::VARCHAR, 7, '0') AS image_id, k.run AS run, round(value, 6) AS confidence, x1 FROM customer CROSS JOIN range(1, 4) k(run) LEFT JOIN runs ON sample_id = c_custkey AND runs.run = k.run")
def infer_reruns(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of each prompt from recorded answers, some of which were never run."""
    runs = a.runs(spark, sf)
    recorded = runs.select(F.lpad(F.col("sample_id").cast("string"), 7, "0").alias("image_id"), F.lit(rules.PERSON).alias("phrase"), "run", F.array(g.to_list(F.col("box"))).alias("boxes"), F.col("value").alias("confidence"))
    found = inference.replay_runs(_prompts(spark, sf), recorded)
    return found.select("image_id", F.col("run").cast("long").alias("run"), _r(F.col("confidence")).alias("confidence"), F.get(F.get("boxes", F.lit(0)), F.lit(2)).alias("x1"))


@query("SELECT lpad(c_custkey::VARCHAR, 7, '0') AS image_id, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal, 6) END AS confidence FROM customer")
def infer_replay(spark: SparkSession, sf: str) -> DataFrame:
    recorded = a.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("image_id"), F.lit(rules.PERSON).alias("phrase"), _r(F.col("c_acctbal")).alias("confidence"))
    return inference.replay(_prompts(spark, sf), recorded).select("image_id", "confidence")


# Beyond the reference: the same rates over windows of a stream


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def windowed_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.rates(a.table(spark, sf, "events"), "1 hour")
    return rows.select(F.unix_seconds("start").alias("start"), "event_type", "n", _r(F.col("mean_value")).alias("mean_value"))


@query(f"WITH {a.SAMPLES} SELECT image_id, primary_class, row_number() OVER (PARTITION BY primary_class ORDER BY sample_id, image_id) AS place FROM samples QUALIFY place <= 500")
def stream_pools(spark: SparkSession, sf: str) -> DataFrame:
    """The pools of the balanced sample from a stream of the samples."""
    rows = a.samples(spark, sf).select("sample_id", "image_id", "primary_class")
    source = tables.scratch(spark, "stream")
    rows.write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    found = pools.fill(stream, list(rules.CLASSES), "primary_class", "image_id", "sample_id", 500, f"{tables.scratch(spark, 'pools')}/out", tables.scratch(spark, "offsets"))
    return found.select("image_id", "primary_class", F.col("place").cast("long").alias("place"))
