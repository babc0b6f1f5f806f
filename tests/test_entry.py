"""The registry without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), len(set(s) - set(q)))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_with_the_operators_deleted(tmp_path, pipeline):
    for name in ("gridloom", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(ROOT / name, tmp_path / name)
    (tmp_path / "gridloom/llm/__pycache__").mkdir(parents=True)  # what deleting the files alone leaves
    said = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    queries, training, unknown = map(int, said.stdout.split())
    assert queries >= 72
    assert (training, unknown) == (0, 0)
