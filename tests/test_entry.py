"""The driver contract: names, schemas, and that the subpackage llm can be absent."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).resolve().parent


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "mean_modal_price" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_needs_llm(tmp_path):
    shutil.copytree(ROOT / "panelkit", tmp_path / "panelkit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    for path in (ROOT / "panelkit").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text()
