"""Executors without a copy of the package run every operator that sends Python code."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
for name in sys.argv[3:]:
    print("ROWS", name, __spark_entry__.queries()[name](spark, sys.argv[2]).count(), flush=True)
"""
NAMES = ["op3_toxicity", "op10_bpe", "op11_rolling_median", "op12_hard_negatives", "op13_passage_removal"]


def test_workers_without_the_package(small, tmp_path):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), small, *NAMES], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=600)
    told = {x.split()[1]: int(x.split()[2]) for x in done.stdout.splitlines() if x.startswith("ROWS")}
    assert set(told) == set(NAMES) and all(told.values()), done.stderr[-2000:]
