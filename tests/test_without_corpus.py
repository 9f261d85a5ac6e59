"""The repository works with the corpus operators' two folders and the pipeline taken out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_entry_without_corpus_operators(tmp_path, pipeline_too):
    gone = {"llm", ".git", "__pycache__"} | ({"corpus_pipeline.py"} if pipeline_too else set())
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda d, names: gone & set(names))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and not [k for k in [*q, *o] if k.startswith('op') and k[2].isdigit() or k == 'pipeline']; assert not set(o) - set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
