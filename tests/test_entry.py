"""The driver's contract, and that the library stands without its training-data subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "word_overlap" in df.columns


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_without_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "inkvane", tmp_path / "inkvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); assert 'regex_features' in q and not any(k.startswith('op') for k in q); E.oracle_sql()\n"
    code += "from pyspark.sql import SparkSession\nspark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\nassert q['regex_features'](spark, E.SMALL).count() > 0"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=180, env=env)


def test_a_missing_library_is_no_missing_subpackage(tmp_path):
    """Without zstandard the entry fails loudly and does not lose ten queries."""
    import shutil

    shutil.copytree(ROOT / "inkvane", tmp_path / "inkvane", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if not (ROOT / "inkvane" / "llm").exists():
        return
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120, capture_output=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False)
    assert got.returncode and b"zstandard" in got.stderr


def test_no_module_outside_imports_it():
    for path in (ROOT / "inkvane").rglob("*.py"):
        if "llm" not in path.parts:
            assert "inkvane.llm" not in path.read_text(), path
