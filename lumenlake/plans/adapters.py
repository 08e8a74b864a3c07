"""Domain views over the driver's tables, each as a DataFrame and as the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.functions import geometry as g
from lumenlake.functions import labels
from lumenlake.operators import sampling

WIDTH, HEIGHT, NEAR = 640.0, 480.0, 80.0
COMPLIANT_EVENTS = ("view", "click", "purchase")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, role, x0, y0, x1, y1 and what decides between equal boxes: a box per line item."""
    t = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_returnflag") == "R", "object").otherwise("worker")
    x0, y0 = F.col("l_quantity") * 4, F.col("l_linenumber") * 20.0
    return t.select(
        F.col("l_orderkey").alias("sample_id"),
        role.alias("role"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 10 + F.round(F.col("l_discount") * 100) * 5).alias("x1"),
        (y0 + 10 + F.round(F.col("l_tax") * 100) * 5).alias("y1"),
        *TIES,
    )


#: What orders boxes of equal corners.
TIES = ["l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus"]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, role, ord, x0, y0, x1, y1: workers first."""
    rows = _boxes(spark, sf_dir)
    order = Window.partitionBy("sample_id").orderBy(F.desc("role"), "y0", "x0", "x1", "y1", *TIES)
    return rows.withColumn("ord", F.row_number().over(order)).select("sample_id", "role", "ord", "x0", "y0", "x1", "y1")


BOXES = """boxes AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY role DESC, y0, x0, x1, y1, l_partkey, l_suppkey, l_extendedprice, l_linestatus) AS ord FROM (
  SELECT l_orderkey AS sample_id, CASE WHEN l_returnflag = 'R' THEN 'object' ELSE 'worker' END AS role, l_quantity * 4 AS x0, l_linenumber * 20.0::DOUBLE AS y0,
    l_quantity * 4 + 10 + round(l_discount * 100) * 5 AS x1, l_linenumber * 20.0::DOUBLE + 10 + round(l_tax * 100) * 5 AS y1, l_partkey, l_suppkey, l_extendedprice, l_linestatus FROM lineitem))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, image_id, violated_rules, primary_class and assigned_rule_id: one per order."""
    t = table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    flags = {
        "rule_1": priority == "1-URGENT",
        "rule_2": priority == "2-HIGH",
        "rule_3": (priority == "3-MEDIUM") & (F.col("o_orderstatus") == "F"),
        "rule_4": F.col("o_totalprice") > 450000,
    }
    rows = sampling.classify(t.withColumn("sample_id", F.col("o_orderkey")).withColumn("image_id", F.lpad(F.col("o_orderkey").cast("string"), 7, "0")), flags)
    return rows.select("sample_id", "image_id", "violated_rules", "primary_class", labels.assigned_rule(F.col("primary_class"), F.col("violated_rules"), F.col("sample_id")).alias("assigned_rule_id"), "o_totalprice", "o_orderpriority")


SAMPLES = """flags AS (SELECT o_orderkey AS sample_id, lpad(o_orderkey::VARCHAR, 7, '0') AS image_id, o_orderpriority = '1-URGENT' AS r1, o_orderpriority = '2-HIGH' AS r2,
  o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' AS r3, o_totalprice > 450000 AS r4, o_totalprice, o_orderpriority FROM orders),
samples AS (SELECT *, concat_ws('|', CASE WHEN r1 THEN 'rule_1' END, CASE WHEN r2 THEN 'rule_2' END, CASE WHEN r3 THEN 'rule_3' END, CASE WHEN r4 THEN 'rule_4' END) AS violated,
  CASE WHEN r1 THEN 'ppe_violation' WHEN r2 OR r3 THEN 'fall_hazard' WHEN r4 THEN 'struck_by_risk' ELSE 'compliant' END AS primary_class,
  CASE WHEN r1 THEN 'rule_1' WHEN r2 THEN 'rule_2' WHEN r3 THEN 'rule_3' WHEN r4 THEN 'rule_4' ELSE 'rule_' || (sample_id % 4 + 1) END AS assigned_rule_id FROM flags)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes with rank by area, the largest first."""
    b = boxes(spark, sf_dir)
    at = g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return b.withColumn("area", g.area(at)).withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("area"), "ord")))


#: Masks of answers: without the so many largest boxes, and as a perturbation loses every fourth box.
MASKS, LOSSES = (0, 1, 2), (0, 1, 2, 3)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with n_regions, top_is_worker, and what is found under each mask k (top_k) and each loss p (lost_p): a struct of
    answer, workers (how many) and object (the first one's box).

    Boxes are ranked by window and joined once with their sample's objects. The best rank of a close object tells for every
    mask whether a worker is covered, and the places of close objects modulo four for every loss. Windows, join and
    groupings are all by sample, so boxes are shuffled once.
    """
    b = ranked(spark, sf_dir)
    at = lambda t: g.box(*(F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")))
    objects = b.filter("role = 'object'").select("sample_id", F.col("ord").alias("o_ord"), F.col("rank").alias("o_rank"), g.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("o_box"))
    near = (F.col("b.sample_id") == F.col("o.sample_id")) & (F.col("b.role") == "worker") & g.close(at("b"), F.col("o.o_box"), NEAR)
    joined = b.alias("b").join(objects.alias("o"), near, "left")
    each = joined.groupBy("b.sample_id", "b.ord").agg(
        F.first("b.role").alias("role"), F.first("b.rank").alias("rank"), F.first(at("b")).alias("box"),
        F.coalesce(F.max("o_rank"), F.lit(0)).alias("best"), F.coalesce(F.bit_or(F.pow(F.lit(2), F.col("o_ord") % 4).cast("int")), F.lit(0)).alias("turns"),
    )
    worker = F.col("role") == "worker"

    def found(kept: Column, covered: Column) -> Column:
        """Under a condition on boxes, and on a worker's close objects."""
        workers, others = F.count_if(kept & worker), F.count_if(kept & ~worker)
        alone = F.when(others > 0, "compliant").otherwise("violation")
        answer = F.when(workers == 0, alone).when(F.count_if(kept & worker & ~covered) == 0, "compliant").otherwise("violation")
        return F.struct(answer.alias("answer"), workers.alias("workers"), F.min_by("box", F.when(kept & ~worker, F.col("ord"))).alias("object"))

    top = {f"top_{k}": found(F.col("rank") > k, F.col("best") > k) for k in MASKS}
    lost = {f"lost_{p}": found((F.col("ord") + p) % 4 != 0, F.col("turns").bitwiseAND(15 - (1 << (4 - p) % 4)) != 0) for p in LOSSES}
    own = each.groupBy("sample_id").agg(F.count("*").alias("n_regions"), F.bool_or(worker & (F.col("rank") == 1)).alias("top_is_worker"), *(v.alias(k) for k, v in (top | lost).items()))
    nothing = F.struct(F.lit("violation").alias("answer"), F.lit(0).cast("long").alias("workers"), F.lit(None).cast(g.BOX).alias("object"))
    whole = samples(spark, sf_dir).join(own, "sample_id", "left")
    return whole.withColumns({"n_regions": F.coalesce("n_regions", F.lit(0).cast("long"))} | {k: F.coalesce(k, nothing) for k in (*top, *lost)})


RANKED = f"""{BOXES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY area DESC, ord) AS rank FROM (SELECT *, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) AS area FROM boxes))"""


def near_sql(a: str, b: str, limit: str = "80") -> str:
    """Closeness of two aliased boxes."""
    dx = f"greatest({b}.x0 - {a}.x1, {a}.x0 - {b}.x1, 0)"
    dy = f"greatest({b}.y0 - {a}.y1, {a}.y0 - {b}.y1, 0)"
    return f"sqrt({dx} * {dx} + {dy} * {dy}) <= {limit}"


def iou_sql(a: str, b: str) -> str:
    both = f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0))"
    size = lambda t: f"(greatest({t}.x1 - {t}.x0, 0) * greatest({t}.y1 - {t}.y0, 0))"
    union = f"({size(a)} + {size(b)} - {both})"
    return f"CASE WHEN {union} > 0 THEN {both} / {union} ELSE 0.0 END"


def answer_sql(name: str, masked: int = 0, kept: str = "") -> str:
    """A view of the presence answer of each sample without its largest boxes, or of the boxes that a condition on {t}ord keeps."""
    cond = lambda t: kept.format(t=t) if kept else f"{t}rank > {masked}"
    return f"""{name} AS (SELECT s.sample_id, CASE WHEN coalesce(n.workers, 0) = 0 THEN CASE WHEN coalesce(n.objects, 0) > 0 THEN 'compliant' ELSE 'violation' END
    WHEN coalesce(m.bare, 0) = 0 THEN 'compliant' ELSE 'violation' END AS answer, coalesce(n.workers, 0) AS workers
  FROM (SELECT o_orderkey AS sample_id FROM orders) s
  LEFT JOIN (SELECT sample_id, count(*) FILTER (WHERE role = 'worker') AS workers, count(*) FILTER (WHERE role = 'object') AS objects FROM ranked WHERE {cond('')} GROUP BY 1) n USING (sample_id)
  LEFT JOIN (SELECT sample_id, count(*) AS bare FROM ranked w WHERE role = 'worker' AND {cond('w.')} AND NOT EXISTS (
    SELECT 1 FROM ranked o WHERE o.sample_id = w.sample_id AND o.role = 'object' AND {cond('o.')} AND {near_sql('w', 'o')}) GROUP BY 1) m USING (sample_id))"""


def runs(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """sample_id, run, answer, and a box: the first events of each user."""
    t = table(spark, sf_dir, "events")
    answer = F.when(F.col("event_type").isin(*COMPLIANT_EVENTS), "compliant").otherwise("violation")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = g.box(F.col("event_id") % 7 * 10.0, F.col("event_id") % 5 * 10.0, F.col("event_id") % 7 * 10.0 + 60, F.col("event_id") % 5 * 10.0 + 40)
    rows = t.withColumn("run", F.row_number().over(order)).filter(F.col("run") <= most)
    return rows.select(F.col("user_id").alias("sample_id"), "run", answer.alias("answer"), at.alias("box"), F.when(F.col("event_type") == "error", "grid").otherwise("model").alias("source"), "value")


def runs_sql(most: int = 3) -> str:
    return f"""runs AS (SELECT user_id AS sample_id, run, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'compliant' ELSE 'violation' END AS answer,
  event_id % 7 * 10.0::DOUBLE AS x0, event_id % 5 * 10.0::DOUBLE AS y0, event_id % 7 * 10.0::DOUBLE + 60 AS x1, event_id % 5 * 10.0::DOUBLE + 40 AS y1,
  CASE WHEN event_type = 'error' THEN 'grid' ELSE 'model' END AS source, value
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) WHERE run <= {most})"""


def heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    return t.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("raw"), "label")


HEATMAPS = "maps AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS raw, label FROM embeddings)"
MIN_MAX = "list_transform(raw, lambda x: CASE WHEN list_max(raw) > list_min(raw) THEN (x - list_min(raw)) / (list_max(raw) - list_min(raw)) ELSE 0.0 END)"
