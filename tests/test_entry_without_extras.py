"""The entry module works where the optional folder and the pipeline have been removed."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_without_the_optional_folder(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "ledgerloom", tmp_path / "ledgerloom", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) >= 41 and set(o) <= set(q) and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "ledgerloom").parts:
            assert "ledgerloom.llm" not in path.read_text(), path
