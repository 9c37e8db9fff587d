"""The entry module without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).parent.parent


@pytest.mark.parametrize("gone", [["meterlake/llm", "tests/llm"], ["meterlake/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_parts_taken_out(tmp_path, gone):
    for name in ("meterlake", "__spark_entry__.py", "corpus_pipeline.py"):
        if (TOP / name).is_dir():
            shutil.copytree(TOP / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (TOP / name).exists():
            shutil.copy(TOP / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) >= 52 and got[1:] == ["False", "True"]
