"""The entry point, with and without the language-model operators, and queries against their SQL."""

import os
import shutil
import subprocess
import sys

import pandas as pd
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
CHECKED = ["box_area", "top_region", "coverage_answer", "coverage_answer_in_row", "answer_rule", "balanced_sample", "metric_summary", "robustness_compare", "answer_agreement", "region_overlap", "topk_mass_ratio", "json_roundtrip", "timing_stats", "image_files", "image_scan", "image_low_light", "image_occlude", "image_blur", "image_contrast", "image_mask", "image_patch", "image_hat", "image_mask_blur", "crowded_coverage", "crowded_pairs", "confidence_quantiles", "robustness_rates", "verdict_share", "sens_spec", "image_boxes", "image_heatmap", "infer_colours", "infer_attention", "infer_reruns", "infer_replay", "flip_rate_corrected", "patch_stretch", "rates_long", "efficiency_summary", "bounded_completeness", "poor_info_subset", "worker_lost_audit", "baseline_rehydration", "attention_heatmap", "csv_typed", "csv_text", "json_table", "answer_phrases", "prompt_texts", "figure_budget"]


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["lumenlake/llm", "tests/llm"], ["lumenlake/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_works_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    left = (copy / "lumenlake/llm/queries.py").exists()  # the subpackage may be gone before
    code = f"import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and any(k.startswith('op') for k in q) == {left}; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def _rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("" if v is None or v is pd.NA or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_the_corrected_flip_rate_is_over_every_sample(spark):
    import __spark_entry__

    found = __spark_entry__.queries()["flip_rate_corrected"](spark, SF).first()
    assert found.n == spark.read.parquet(f"{SF}/orders.parquet").count() and 0 < found.n_eligible < found.n
