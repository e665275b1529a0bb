import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
PROGRAM = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {scratch!r}).getOrCreate())
import __spark_entry__ as entry
sys.path.remove({root!r})
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert query(spark, "/root/testdata/sf0.001").collect(), name
print("all done")
"""


def test_executors_need_not_have_the_package(tmp_path):
    """The driver alone knows where the package is."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(root=str(ROOT), scratch=str(tmp_path / "scratch"))
    said = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "all done" in said.stdout, said.stderr[-3000:]
