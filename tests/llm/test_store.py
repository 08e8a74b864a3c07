"""Written tables: what goes when."""

import os
import subprocess
import sys

from lumenlake.llm import _store


def _there(spark) -> set[str]:
    top = _store.shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/lumenlake"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_scopes(spark):
    before = _there(spark)
    with _store.scope():
        one = _store.written(spark.range(3), "one")
        with _store.scope():
            two = _store.result(_store.written(one, "inner"), "two")
        assert two.count() == 3 and len(_there(spark) - before) == 2
        three = _store.result(two, "three")
    assert three.count() == 3 and len(_there(spark) - before) == 1
    _store.drop(three)
    assert _there(spark) == before


def test_hashes_are_held_back_but_never_lost(spark):
    rows = spark.range(-3000, 3000).selectExpr("id", "xxhash64(id) AS h")
    test = _store.among(rows.filter("id % 3 = 0").select("h"))
    passed = {r.id for r in rows.filter(test(rows["h"])).collect()}
    assert passed >= {i for i in range(-3000, 3000) if i % 3 == 0} and len(passed) < 2100
    assert rows.filter(_store.among(rows.filter("false").select("h"))(rows["h"])).count() == 0


def test_the_pipeline_leaves_its_result_only(spark):
    import corpus_pipeline

    before = _there(spark)
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = _there(spark) - before
    assert rows.count() > 0 and {x.rpartition("-")[0] for x in left} <= {"packing", "again", "near"}


def test_nothing_is_left_after_the_session(tmp_path):
    """Also where the caller stops its session first."""
    code = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
from lumenlake.llm import _store
assert _store.written(spark.range(5), "x").count() == 5 and sys.argv[1] in _store.shared_dir(spark)
spark.stop()
"""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, cwd=repo, env=os.environ | {"PYTHONPATH": repo})
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]
