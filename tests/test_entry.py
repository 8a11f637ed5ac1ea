"""The entry module without the training-text folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("tessera/llm", "tests/llm"), ("tessera/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_imports_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for x in gone:
        shutil.rmtree(copy / x, ignore_errors=True) if (copy / x).is_dir() else (copy / x).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=copy, env=env, capture_output=True, text=True, check=True)
    names = said.stdout.split()
    assert "bm25_topk" in names and "pipeline" not in names
    assert any(x.startswith("op") for x in names) == ((copy / "tessera/llm").exists())
