"""Scratch tables: where they go, and who deletes which."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from asofar.llm import common, queries

SF = "/root/testdata/sf0.001"


def test_a_run_deletes_its_own_tables_only(spark):
    held = queries.queries()["op2_simhash_dedup"](spark, SF)
    before = held.count()
    out = corpus_pipeline.run(spark, SF)
    assert held.count() == before
    assert out.count() > 0


def test_a_query_leaves_what_its_result_reads(spark):
    mark = common.scratch_mark()
    out = queries.queries()["op2_simhash_dedup"](spark, SF)
    left = [path for number, _, path in common._scratch if number > mark]
    files = " ".join(out.inputFiles())
    assert left and all(path.rsplit("/", 1)[1] in files for path in left)
    folder = common.shared_dir(spark).removeprefix("file:")
    assert all(os.path.isdir(path.removeprefix("file:")) and path.removeprefix("file:").startswith(folder) for path in left)
    common.release(mark)
    assert not any(os.path.exists(path.removeprefix("file:")) for path in left)


class _Session:
    """A session without the setting, of a cluster."""

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_without_the_setting():
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(_Session())


def test_a_local_session_without_the_setting(tmp_path):
    """Scratch tables lie in the warehouse's folder and go at exit."""
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{tmp_path}/wh").getOrCreate()
from asofar.llm import common
df = common.materialize(s.range(5), "t")
assert df.count() == 5 and "{tmp_path}/wh/_scratch" in df.inputFiles()[0]
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "SPARK_CONF_DIR": str(tmp_path)}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not list((tmp_path / "wh" / "_scratch").rglob("*.parquet"))
