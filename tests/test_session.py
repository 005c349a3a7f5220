"""The shared folder: read from the session, made only for a local master, one subfolder per application."""

import os
import subprocess
import sys

import pytest

from corpuslens.session import private_folder


def test_other_masters_need_a_shared_folder():
    with pytest.raises(RuntimeError):
        private_folder("spark://host:7077")


def test_a_session_without_a_folder_writes_tables(tmp_path):
    code = """
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate())
from corpuslens.session import checkpoint_dir, materialise
assert not spark.conf.get("spark.checkpoint.dir", None)
assert materialise(spark.range(3)).count() == 3
assert checkpoint_dir(spark) == checkpoint_dir(spark)
print("fine")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.stdout.strip().endswith("fine"), run.stderr[-1500:]
