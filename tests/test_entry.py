"""The entry module, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "colmerge", tmp_path / "colmerge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'materialize_rows' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    told = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    assert int(told.stdout) >= 60


def test_without_what_the_optional_subpackage_needs(tmp_path):
    shutil.copytree(ROOT / "colmerge", tmp_path / "colmerge", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import sys; sys.modules['numpy'] = None; import __spark_entry__ as e; q = e.queries(); assert 'materialize_rows' in q and 'pipeline' not in q"
    told = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "colmerge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "colmerge.llm" not in path.read_text()
