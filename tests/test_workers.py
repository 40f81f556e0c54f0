"""User functions reach workers that start in another folder, without the repository on their path."""

from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from panelspark.session import build_session, local_conf
spark = build_session("workers", "local[2]", {**local_conf(2), "spark.checkpoint.dir": sys.argv[2]})
queries = entry.queries()
for name in ("forecast_persistence", "run_summary", "deletion_insertion_curves", "dm_p_value", "study_summary"):
    assert queries[name](spark, sys.argv[3]).collect(), name
print("all ran")
"""


def test_queries_run_from_another_folder(tmp_path, sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, os.path.join(root, "__spark_entry__.py"), str(tmp_path / "shared"),
                          sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in out.stdout, out.stderr[-3000:]
