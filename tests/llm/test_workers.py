"""Task code travels by value: workers that have no install of the package run the operators."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")


def there(_):
    try:
        import tabforge
        return [tabforge.__file__]
    except ModuleNotFoundError:
        return ["none"]


assert spark.sparkContext.parallelize([1], 1).mapPartitions(there).collect() == ["none"]
from tabforge.llm.queries import QUERIES
for name in {names!r}:
    assert QUERIES[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_workers_without_the_package(tmp_path, sf_dir):
    names = ["op1_byte_bpe", "op2_collision_near_dedup", "op3_line_dedup", "op4_token_counts", "op6_minmax_near_dedup", "op11_hard_negatives",
             "op12_spelling_variants", "op13_hash_prefix_forest"]
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=str(ROOT), shared=f"file://{tmp_path}/shared", names=names, sf=sf_dir))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and "all ran" in done.stdout, done.stderr[-3000:]
