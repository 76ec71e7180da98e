"""The rest of the library without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT


@pytest.mark.parametrize("gone", [["skeinflow/llm", "tests/llm", "corpus_pipeline.py"], ["skeinflow/llm", "tests/llm"]])
def test_entry_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e, skeinflow.catalog as c; assert set(e.queries()) == set(c.queries()) and set(e.oracle_sql()) == set(c.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
