"""Tables with fixed schemas: ids keep their zeros, JSON cells keep their quotes, NaN reads as null.

Between stages Parquet is the format; CSV is for exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "image_id STRING, assigned_rule_id STRING, primary_class STRING"
SCHEMAS: dict[str, str] = {
    "samples": "image_id STRING, split STRING, primary_class STRING, violated_rule_ids STRING, assigned_rule_id STRING",
    "baseline_predictions": "image_id STRING, primary_class STRING, assigned_rule_id STRING, answer STRING, worker_boxes STRING, object_boxes STRING, confidence DOUBLE, inference_ms DOUBLE, caption STRING",
    "region_extraction": "image_id STRING, assigned_rule_id STRING, n_regions INT, top_region_source STRING, top_region_label STRING, top_region_box STRING",
    "descriptive_accuracy": "image_id STRING, primary_class STRING, assigned_rule_id STRING, baseline_answer STRING, n_regions INT, answer_changed_top1 BOOLEAN, answer_changed_top2 BOOLEAN, masked_answer_top1 STRING, masked_answer_top2 STRING, confidence_drop_top1 DOUBLE, confidence_drop_top2 DOUBLE",
    "visual_sparsity": f"{KEYS}, attributed_phrase STRING, n_generated_tokens INT, topk5_mass_ratio DOUBLE, topk20_mass_ratio DOUBLE, `regions_above_0.5` DOUBLE, excluded_reason STRING",
    "stability": f"{KEYS}, deterministic_answer STRING, sampled_answers STRING, answer_agreement_rate DOUBLE, majority_sampled_answer STRING, deterministic_matches_majority BOOLEAN, top_region_overlap_score DOUBLE, object_region_overlap_score DOUBLE",
    "robustness": f"{KEYS}, level STRING, perturbation STRING, answer_changed BOOLEAN, confidence_drop DOUBLE, object_box_iou DOUBLE, worker_lost BOOLEAN, excluded_reason STRING",
    "robustness_patch_stretch": "image_id STRING, baseline_answer STRING, patched_answer STRING, flipped_to_compliant BOOLEAN",
    "bounded_completeness": f"{KEYS}, verdict STRING, is_multi_rule_violation BOOLEAN, quality_of_info STRING, top_region_source STRING, worker_lost_in_top1_mask BOOLEAN",
    "efficiency_summary": "day INT, name STRING, calls_per_sample DOUBLE, mean_ms_per_call DOUBLE, mean_ms_per_sample DOUBLE, observed_total_seconds DOUBLE, n_observed STRING, extrapolated_1000_minutes DOUBLE, extrapolated_1000_hours DOUBLE",
    "metric_summary": "metric STRING, direction STRING, overall DOUBLE, compliant DOUBLE, ppe_violation DOUBLE, fall_hazard DOUBLE, struck_by_risk DOUBLE, n STRING, source_csv STRING",
    "source_rows": "image BINARY, image_id STRING, image_caption STRING, illumination STRING, camera_distance STRING, view STRING, quality_of_info STRING, "
    + ", ".join(f"rule_{i}_violation STRUCT<bounding_box: ARRAY<ARRAY<DOUBLE>>, reason: STRING>" for i in (1, 2, 3, 4)),
}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of SCHEMAS; malformed rows fail instead of shifting columns."""
    df = spark.read.csv(path, header=True, schema=SCHEMAS[table], escape='"', multiLine=True, mode="FAILFAST")
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in doubles})


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` STRING" for c in columns), escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays of text are piped, other nested columns are JSON."""
    out = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            out[f.name] = F.array_join(F.col(f"`{f.name}`"), "|")
        elif kind.startswith(("array", "struct", "map")):
            out[f.name] = F.to_json(F.col(f"`{f.name}`"))
    df.withColumns(out).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def number(text: Column) -> Column:
    """A text cell as a number; null for what is none, NaN among it."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables that last as long as the driver, in the folder that the session shares with its executors."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as image_id (the file's name without its suffix) and bytes."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("image_id"), F.col("content").alias("image"))


def probe(df: DataFrame) -> DataFrame:
    """The first row, to see that a source can be read."""
    return df.limit(1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to a scratch folder and read back: what later steps read more than once."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
