"""The entry module works from any folder, in a plain session."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as e
assert e.entry(spark).count() == 6
for name in ("parse_verdicts", "clean_texts", "validity_features", "kappa_bootstrap_multinomial"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    e.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
for name in ("span_log_stream", "early_verdicts"):        # their workers see no files that were added to the session
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


def test_runs_outside_the_repository(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-3000:]
