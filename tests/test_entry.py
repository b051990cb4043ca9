"""The entry module with and without the optional parts of the tree."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("gridloom/llm", "tests/llm"), ("gridloom/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_optional_parts(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc", ".pytest_cache"))
    for name in gone:
        path = tree / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    told = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tree, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    queries, sql = map(int, told.stdout.split()[-2:])
    assert queries >= 100 and sql >= 100
