"""The entry point with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "parcelflow", tmp_path / "parcelflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, corpus = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).stdout.split()
    assert int(n) > 80 and corpus == "False"


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "parcelflow").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "parcelflow.llm" not in p.read_text() and "import llm" not in p.read_text(), p
