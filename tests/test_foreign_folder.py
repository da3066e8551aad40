"""Workers must not need the package: the driver finds it by sys.path, executors get functions by value."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parent.parent)
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
queries = e.queries()
for name in sys.argv[2:]:
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("DONE")
"""


def run_elsewhere(folder, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, REPO, *names], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("DONE"), out.stderr[-3000:]


def test_queries_with_python_workers(tmp_path):
    run_elsewhere(tmp_path, ["match_verdicts", "diff_paragraph", "apply_sequential", "scan_package_elements", "check_package_settings", "repair_packages", "edit_packages", "office_parts", "sql_functions", "fallback_outcome"])
