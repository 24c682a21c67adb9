"""The library and its entry point stand without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op1') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("left", ["nothing", "pipeline", "empty folder"])
def test_entry_point_without_the_corpus_operators(tmp_path, left):
    shutil.copytree(ROOT / "linewave", tmp_path / "linewave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "pipeline" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if left == "empty folder":
        (tmp_path / "linewave" / "llm" / "__pycache__").mkdir(parents=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    n, *flags = got.stdout.split()
    assert int(n) > 50 and flags == ["False", "False", "True"]


def test_nothing_else_imports_them():
    for path in (ROOT / "linewave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "linewave.llm" not in path.read_text(), path
