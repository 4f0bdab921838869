"""Python workers run without the package on their path."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from textmill.plans import all_queries
from textmill.session import local_session
spark = local_session(2)
for name in (
    "tokenize_bpe", "pack_no_wrap", "tokenize_code_points", "preprocess_lines", "json_line_positions", "merge_root_parts"
):
    assert all_queries()[name](spark, {sf!r}).count() > 0
print("done")
"""


def test_workers_need_no_package(tmp_path, sf):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, sf=sf)],
        cwd=tmp_path,
        env=env,
        capture_output=True,
        text=True,
        timeout=600,
    )
    assert made.returncode == 0 and "done" in made.stdout, made.stderr[-2000:]
