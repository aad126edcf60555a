"""Executors without a copy of the package: what is sent to them has to be enough."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})  # the driver's only: workers don't inherit it
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def importable(_):
    import importlib.util
    return [importlib.util.find_spec("lodestrand") is not None]

assert spark.sparkContext.parallelize([0], 1).flatMap(importable).collect() == [False]
import __spark_entry__ as entry
for name in {names!r}:
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
    print("done", name)
"""


def test_queries_run_without_the_package_on_workers(sf, tmp_path):
    names = ["op1_decontaminate", "op2_chat", "op3_importance", "op4_tokens", "op6_neighbours", "op9_simhash", "op10_toxicity", "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, names=names, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [x.split()[1] for x in done.stdout.splitlines() if x.startswith("done ")] == names, done.stderr[-3000:]
