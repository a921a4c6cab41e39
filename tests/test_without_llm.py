"""The engine without the training-data subpackage, its tests and its pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["tessera/llm", "tests/llm"], ["tessera/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *[Path(g).name for g in gone]))
    assert not any((copy / g).exists() for g in gone)
    code = "import re, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and 'pipeline' not in q and not [k for k in q if re.match('op[0-9]', k)]; assert callable(e.entry)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
