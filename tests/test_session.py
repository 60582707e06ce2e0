"""Checkpoint folder rules, in sessions of their own processes."""

import subprocess
import sys
import textwrap

import pytest

from kwhlens.session import Scratch


def run(code, **conf):
    builder = "".join(f".config({k!r}, {v!r})" for k, v in conf.items())
    script = textwrap.dedent(f"""
        from pyspark.sql import SparkSession
        from kwhlens.session import checkpoint_dir
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false"){builder}.getOrCreate()
    """) + textwrap.dedent(code)
    return subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)


def test_plain_local_session_gets_a_scratch_folder():
    done = run("""
        d = checkpoint_dir(spark)
        assert d and checkpoint_dir(spark) == d and spark.range(3).checkpoint().count() == 3
    """)
    assert done.returncode == 0, done.stderr[-2000:]


def test_callers_folder_is_kept(tmp_path):
    done = run(f"""
        spark.sparkContext.setCheckpointDir({str(tmp_path)!r})
        before = spark.sparkContext.getCheckpointDir()
        assert checkpoint_dir(spark) == before and before.startswith("file:{tmp_path}")
        assert spark.sparkContext.getCheckpointDir() == before
    """)
    assert done.returncode == 0, done.stderr[-2000:]


def test_setting_is_read(tmp_path):
    done = run(f"assert checkpoint_dir(spark).startswith('file:{tmp_path}')", **{"spark.checkpoint.dir": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]


def test_cluster_without_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf: dict = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        from kwhlens.session import checkpoint_dir

        checkpoint_dir(Session())


def test_scratch_tables_are_removed(spark):
    with Scratch(spark) as scratch:
        t = scratch.table(spark.range(5), "t")
        assert t.count() == 5
        path = scratch.path
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{path}/t").count()
