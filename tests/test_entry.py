"""The entry module where the training-data operators are not there, or only what Python left of them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("cache", [True, False])
def test_entry_without_the_operators(tmp_path, pipeline, cache):
    shutil.copytree(REPO / "scriptorium", tmp_path / "scriptorium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    if cache:
        (tmp_path / "scriptorium" / "llm" / "__pycache__").mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n, known, operators, pipeline = out.stdout.split()
    assert int(n) > 250 and known == "True" and operators == "False" and pipeline == "False"
