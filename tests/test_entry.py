"""The entry module without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("path", [None, str(ROOT)])
@pytest.mark.parametrize("gone", [("strandlake/llm", "tests/llm"), ("strandlake/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without(tmp_path, gone, path):
    """Also where another copy of what is gone can be found on the path."""
    names = [p for p in ("__spark_entry__.py", "corpus_pipeline.py", "strandlake") if p not in gone and (ROOT / p).exists()]
    for name in names:
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": path} if path else {})
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 50 and int(out[1]) > 50 and out[2] == "False"
