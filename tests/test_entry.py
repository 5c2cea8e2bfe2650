"""The driver's contract, also where the training-data subpackage is deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
TRY = """
import __spark_entry__ as E
from pyspark.sql import SparkSession
assert E.queries() and set(E.oracle_sql()) <= set(E.queries())
assert not any(name.startswith("op") and name[2].isdigit() or name == "pipeline" for name in E.queries())
if {run}:
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    assert E.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = TRY.format(run=os.path.isdir(SMALL) and pipeline)
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
