"""The driver's entry points without the optional package."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LOOK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sorted(q) == sorted(k for k in q if not (k.startswith('op') and k[2].isdigit()) and k != 'pipeline'), len(q))"


def _copy(to: Path) -> None:
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))


def test_entry_without_the_optional_package(tmp_path):
    for name, gone in (("folders", []), ("all", ["corpus_pipeline.py"]), ("left", [])):
        at = tmp_path / name
        _copy(at)
        for file in gone:
            (at / file).unlink(missing_ok=True)
        if name == "left":  # what an interpreter leaves in a folder
            (at / "quarry" / "llm" / "__pycache__").mkdir(parents=True)
        out = subprocess.run([sys.executable, "-c", LOOK], cwd=at, capture_output=True, text=True, timeout=120)
        assert out.stdout.startswith("True"), out.stderr[-2000:]
