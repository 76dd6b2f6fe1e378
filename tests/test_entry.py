"""The entry module works without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    shutil.copytree(os.path.join(ROOT, "codeloom"), tmp_path / "codeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n[:2] == 'op' and n[2].isdigit()]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)
