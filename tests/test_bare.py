"""Queries on workers that do not have the package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
probe = lambda it: (__import__("importlib.util").util.find_spec("netloom") is not None for _ in it)
assert not any(spark.sparkContext.parallelize([1], 1).mapPartitions(probe).collect()), "the workers have the package"
from netloom.plans.core import QUERIES
for name in sys.argv[1:]:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_folds_decoders_and_sources_travel(tmp_path):
    names = ["paced_sample", "dns_transactions", "decoded_payloads", "desegmented_http", "rejoined_datagrams", "flow_table", "capture_round_trip", "followed_streams"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = {k: int(v) for k, v in (line.split() for line in done.stdout.splitlines())}
    assert set(counts) == set(names) and counts["paced_sample"] == counts["decoded_payloads"] == counts["capture_round_trip"] == 1000 and all(counts.values())
