"""Tables in the shared folder: read back as written, gone when the driver ends, and an error on a cluster without such a folder."""

import os
import subprocess
import sys
import time

import pytest

from genoflux.sources import scratch


def test_kept_table_and_cluster_without_folder(spark):
    df = spark.range(5)
    assert sorted(r.id for r in scratch.kept(df).collect()) == list(range(5))

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_folders_go_with_the_driver(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from genoflux.sources.scratch import kept
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert kept(s.range(3)).count() == 3
import os
assert os.listdir("{tmp_path}")
s.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120, env=os.environ | {"PYTHONPATH": root})
    for _ in range(60):  # the JVM ends a little after the driver's Python
        left = [x for x in os.listdir(tmp_path) if x.startswith("files-")]  # Spark keeps a folder of its own there
        if not left:
            return
        time.sleep(0.5)
    raise AssertionError(left)
