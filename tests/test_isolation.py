"""The library without its optional parts."""

import os
import shutil
import subprocess
import sys

from .conftest import ROOT

SCRIPT = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert "merge_dedup_first" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.entry(spark).count())
"""


def test_without_the_optional_folders(tmp_path):
    """The rest imports and runs when the folders of the operators for training data are gone, with or without corpus_pipeline.py."""
    for gone in ([], ["corpus_pipeline.py"]):
        root = tmp_path / f"copy{len(gone)}"
        shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *gone))
        assert not os.path.exists(root / "sparkloom/llm") and os.path.exists(root / "corpus_pipeline.py") != bool(gone)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]
