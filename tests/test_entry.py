"""The entry from copies of the repository that lack its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from priorview.plans import registry

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_without_training_data_operators(tmp_path, also):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *also))
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"],
                          cwd=tmp_path / "copy", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert [line.split() for line in said.stdout.splitlines()] == [sorted(registry.QUERIES), sorted(registry.ORACLES)]
