"""Executors that do not share the driver's folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT, DATA = Path(__file__).resolve().parents[2], "/root/testdata/sf0.001"
CODE = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import corpus_pipeline as cp
docs = spark.read.parquet("{DATA}/documents.parquet")
print("kept", cp.pass_classifier(spark, docs, "{DATA}").count())
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_the_package_reaches_executors_of_a_driver_in_its_folder(tmp_path):
    own = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "SPARK_", "PYSPARK_"))}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, env=own | {"SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_WORKER_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=200)
    assert "kept " in done.stdout, done.stderr[-2000:]
