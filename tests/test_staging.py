import os
import subprocess
import sys

from pyspark.sql import functions as F

from textmill import staging

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from textmill.session import local_session
from textmill.staging import drop_staged, stage, staging_root
spark = local_session(1)
first = staging_root(spark)
assert stage(spark.range(3), "x").count() == 3 and staging_root(spark) == first
drop_staged(spark)
print("done", first)
"""


def test_staged_tables_lie_in_the_named_folder(spark):
    root = staging.staging_root(spark)
    assert root.startswith(spark.conf.get("spark.checkpoint.dir"))
    table = staging.stage(spark.range(5).withColumn("v", F.lit("a")), "numbers")
    assert all(root in path for path in table.inputFiles()) and table.count() == 5


def test_only_small_summaries_are_broadcast(spark, monkeypatch):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(staging.stage_summary(spark.range(5), "small"))
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 4)
    assert not hinted(staging.stage_summary(spark.range(5), "large"))


def test_a_local_session_without_the_setting_gets_a_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)],
        cwd=tmp_path,
        env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)},
        capture_output=True,
        text=True,
        timeout=120,
    )
    assert made.returncode == 0 and "textmill-" in made.stdout, made.stderr[-2000:]
