"""The package reaches workers that have no path to it."""

import os
import subprocess
import sys
import tempfile

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
from signalloom.operators import chunking
from signalloom.session import ship_package
ship_package(spark)
lines = spark.range(50).selectExpr("'t' AS testcase_id", "id + 1 AS event_index", "7 AS length")
print("chunks", chunking.chunk_bounds(lines, 60, 15).count())
spark.stop()
"""


def test_a_session_outside_the_repository_runs_python_steps():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
        # the workers of a local session have the path of none but their own folder; the driver finds the package by its own path, the workers by what was shipped
        run = subprocess.run([sys.executable, "-c", CODE.format(root=root, shared=folder)], cwd=folder, env=env,
                             capture_output=True, text=True, timeout=240)
    assert "chunks " in run.stdout, run.stderr[-2000:]
