"""The driver's contract, also without the llm subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["record", "segment_id", "DASDV", "LOG", "MTKE"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_llm(tmp_path):
    for name in ("undula", "__spark_entry__.py"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for p in [*(REPO / "undula").rglob("*.py"), REPO / "bench.py"]:
        if "llm" not in p.relative_to(REPO).parts:
            assert "undula.llm" not in p.read_text(), p
