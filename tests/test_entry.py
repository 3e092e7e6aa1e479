"""The entry module in a copy of the repository without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from ledgerkit.plans.queries import QUERIES

_REPO = Path(__file__).resolve().parents[1]
_LEDGER = set(QUERIES)


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    for name in ("__spark_entry__.py", "corpus_pipeline.py") if pipeline else ("__spark_entry__.py",):
        if (_REPO / name).exists():
            shutil.copy(_REPO / name, tmp_path / name)
    shutil.copytree(_REPO / "ledgerkit", tmp_path / "ledgerkit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert set(done.stdout.split()) == _LEDGER


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
