"""The entry with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def run(folder, script=SCRIPT):
    return subprocess.run([sys.executable, "-c", script], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_training_data_operators(tmp_path, left_out):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(*left_out, ".git", "__pycache__"))
    done = run(tmp_path / "r")
    assert done.stdout.split()[-2:] == ["False", "True"] and int(done.stdout.split()[-3]) > 50, done.stderr[-800:]


def test_other_missing_modules_are_errors(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "r" / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = run(tmp_path / "r")
    assert done.returncode and "no_such_module" in done.stderr


def test_nothing_else_imports_them():
    for f in ROOT.rglob("corpusloom/**/*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
